"""License scan by ordered signature rules.

A rule is a regular expression with a keyword, a hint (a literal part of its matches), a label and a
priority. The rules are made from a table of licenses and a table of the phrases in which their names
occur; a whole name is also a rule alone, as in a heading, and the bodies of common licenses have rules
of their own. White space, line ends and the comment marks after them count as one space. The text is
searched in tiles of ``TILE`` characters with ``REACH`` more behind them, more than the longest match has,
only if they hold a keyword, and by the rules whose keyword and hint they hold only. A rule is detected at every
character where it matches, so that tiles make no difference. Of overlapping detections the one that contains the
other wins if its priority is not lower; of equal intervals the earlier rule wins. Places are characters
of the text with its white space collapsed. Besides the rules three base phrases are found as consecutive
words anywhere in the text.

Everything is one projection of DataFrame expressions, without shuffle.

Defined results: a null or empty text has no words, no places, null first and last word, empty labels
and score 0. Null and repeated ids are rows like others; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import text_rows

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Label, then the names of a license as regular expressions; a name is a rule in each phrase below.
LICENSES = (
    ("agpl", r"(?:gnu )?affero general public licen[sc]e", r"gnu agpl", r"agpl"),
    ("apache", r"apache licen[sc]e", r"apache software licen[sc]e", r"apache"),
    ("artistic", r"artistic licen[sc]e", r"perl artistic licen[sc]e"),
    ("boost", r"boost software licen[sc]e", r"bsl"),
    ("bsd", r"bsd licen[sc]e", r"(?:new|modified|simplified|revised) bsd licen[sc]e", r"bsd \d[ -]clause(?: \W?\w{1,20}\W?)?(?: or \W?\w{1,20}\W?)? licen[sc]e", r"bsd"),
    ("cc-by", r"creative commons attribution", r"cc[ -]by"),
    ("cc-by-nc", r"creative commons attribution[ -]non-?commercial", r"cc[ -]by-nc"),
    ("cc-by-nc-nd", r"creative commons attribution[ -]non-?commercial[ -]no ?deriv\w{0,12}", r"cc[ -]by-nc-nd"),
    ("cc-by-nc-sa", r"creative commons attribution[ -]non-?commercial[ -]share-? ?alike", r"cc[ -]by-nc-sa"),
    ("cc-by-nd", r"creative commons attribution[ -]no ?deriv\w{0,12}", r"cc[ -]by-nd"),
    ("cc-by-sa", r"creative commons attribution[ -]share-? ?alike", r"cc[ -]by-sa"),
    ("cc0", r"creative commons zero", r"cc0"),
    ("cddl", r"common development and distribution licen[sc]e", r"cddl"),
    ("cecill", r"cecill(?: free software)? licen[sc]e", r"cecill"),
    ("epl", r"eclipse public licen[sc]e", r"epl"),
    ("eupl", r"european union public licen[sc]e", r"eupl"),
    ("fdl", r"gnu free documentation licen[sc]e", r"gfdl"),
    ("gpl", r"(?:gnu )?general public licen[sc]e", r"gnu gpl", r"gpl"),
    ("isc", r"isc licen[sc]e", r"isc"),
    ("lgpl", r"(?:gnu )?(?:lesser|library) general public licen[sc]e", r"gnu lgpl", r"lgpl"),
    ("mit", r"mit licen[sc]e", r"expat licen[sc]e", r"mit"),
    ("mpl", r"mozilla public licen[sc]e", r"mpl"),
    ("ofl", r"sil open font licen[sc]e", r"ofl"),
    ("python", r"python software foundation licen[sc]e", r"psf licen[sc]e"),
    ("unlicense", r"unlicen[sc]e", r"the unlicen[sc]e"),
    ("wtfpl", r"do what the f(?:uck|[\w*]{1,20}) you want to public licen[sc]e", r"wtfpl"),
    ("zlib", r"zlib(?:/libpng)? licen[sc]e", r"zlib"),
)
#: Keyword, phrase and weight; {} is the name. Later phrases have lower priority.
PHRASES = (
    ("spdx", r"spdx-licen[sc]e-identifier: ?{}", 1.0),
    ("licen", r"licen[sc]ed (?:under|by|with) (?:the )?(?:terms of )?(?:the )?{}", 0.95),
    ("releas", r"released (?:under|by|with) (?:the )?(?:terms of )?(?:the )?{}", 0.95),
    ("distribut", r"(?:re)?distributed (?:under|by|with) (?:the )?(?:terms of )?(?:the )?{}", 0.95),
    ("available", r"(?:made )?available under (?:the )?(?:terms of )?(?:the )?{}", 0.9),
    ("licen", r"licen[sc]e ?[:=] ?(?:the )?{}", 0.9),
)
VERSION = r"(?:,? (?:version |v)?\d{1,8}(?:\.\d{1,8}){0,4})?"
#: Statements that name no license: keyword, pattern, label, weight.
STATEMENTS = (
    ("reserved", r"all rights reserved", "reserved", 0.8),
    ("reserved", r"(?:some|no) rights reserved", "partly-reserved", 0.6),
    ("copyright", r"copyright (?:\(c\)|©)? ?\d{4}", "copyright", 0.6),
    ("domain", r"(?:released|dedicated|placed|is) (?:in|into|to) the public domain", "public-domain", 0.8),
)
#: Weight of a whole name alone, as in a heading.
NAMED = 0.6
#: Sentences of license bodies and of the notices that go with them: keyword, hint, pattern, label, weight.
BODIES = (
    ("permission", "permission is hereby granted", r"permission is hereby granted,? free of charge(?:,? to any person obtaining a copy(?: of this software and associated documentation files)?)?", "mit", 0.9),
    ("permission", "person or organization", r"permission is hereby granted,? free of charge,? to any person or organization obtaining a copy of the software", "boost", 0.9),
    ("permission", "with or without fee", r"permission to use,? copy,? modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted", "isc", 0.9),
    ("distribut", "in source and binary forms", r"redistributions? and use in source and binary forms(?:,? with or without modification,? are permitted)?", "bsd", 0.9),
    ("licen", "you may not use this file", r"you may not use this file except in compliance with the licen[sc]e", "apache", 0.9),
    ("licen", "no-charge, royalty-free", r"perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright licen[sc]e to reproduce, prepare derivative works of", "apache", 0.9),
    ("licen", "general public license is a free", r"the gnu general public license is a free, copyleft license for software", "gpl", 0.9),
    ("licen", "general public license is a free", r"the gnu affero general public license is a free, copyleft license for software", "agpl", 0.9),
    ("licen", "incorporates the terms", r"this version of the gnu lesser general public license incorporates the terms", "lgpl", 0.9),
    ("licen", "this source code form", r"this source code form is subject to the terms of the mozilla public licen[sc]e", "mpl", 0.9),
    ("licen", "eclipse public licen", r"accompanying program is provided under the terms of this eclipse public licen[sc]e", "epl", 0.9),
    ("licen", "result of discussions", r"this agreement is a free software licen[sc]e agreement that is the result of discussions between its authors", "cecill", 0.9),
    ("domain", "free and unencumbered", r"this is free and unencumbered software released into the public domain", "unlicense", 0.9),
    ("domain", "with this deed", r"the person who associated a work with this deed has dedicated the work to the public domain", "cc0", 0.9),
    ("copyright", "affirmer", r"affirmer\W?s copyright and related rights", "cc0", 0.9),
    ("permission", "to anyone to use this software", r"permission is granted to anyone to use this software for any purpose,? including commercial applications", "zlib", 0.9),
    ("distribut", "verbatim copies of the", r"make and give away verbatim copies of the (?:source|standard)[^.]{0,80} without restriction", "artistic", 0.8),
    ("available", "psf is making python", r"psf is making python available to licensee", "python", 0.9),
)
#: White space, with the comment marks that follow a line end.
_BLANK = r"[\s\x85\xa0\u2000-\u200a\u2028\u2029\u202f\u3000]"
BLANKS = rf"{_BLANK}++(?:(?<=[\n\r\x85\u2028\u2029]{_BLANK}{{0,40}})[*#/;%>|!-](?:{_BLANK}|[*#/;%>|!-])*+)?"
#: Characters of a tile, and how many more are searched with it; no rule matches as many.
TILE, REACH = 500, 400


def _hint(name: str) -> str:
    """The longest literal part of a name, which each of its matches holds."""
    parts = re.split(r"\(\?:.*\)\??|\[[^]]*\]\??|\\\w(?:[*+]|\{[^}]*\})?|.\?", name)
    return max(parts, key=len)


def _headings() -> list[tuple[str, str, str, str]]:
    """Keyword, hint, name and label of the names that say "license", and of those of Creative Commons."""
    keywords = {"licen": "licen[sc]e", "commons": "creative commons"}
    found = [(k, _hint(n), n, label) for label, *names in LICENSES for n in names for k, sign in keywords.items() if sign in n]
    return [*found, ("universal", "cc0", r"cc0 1\.0 universal", "cc0")]


def rules() -> list[tuple[str, str, str, str, int, float]]:
    """Keyword, hint, pattern, label, priority and weight of every rule, by descending priority."""
    made = [
        (keyword, _hint(name), rf"\b{phrase.format(name)}\b{VERSION}", label, len(PHRASES) + 1 - place, weight)
        for place, (keyword, phrase, weight) in enumerate(PHRASES)
        for label, *names in LICENSES
        for name in names
    ]
    made += [(keyword, keyword, pattern, label, 1, weight) for keyword, pattern, label, weight in STATEMENTS]
    made += [(keyword, hint, rf"\b{pattern}\b", label, 1, weight) for keyword, hint, pattern, label, weight in BODIES]
    return made + [(keyword, hint, rf"\b{name}\b{VERSION}", label, 1, NAMED) for keyword, hint, name, label in _headings()]


def _rule_array() -> Column:
    """The rules with their patterns as the characters at which they match, all but the first of a tile."""
    names = ("keyword", "hint", "pattern", "label", "priority", "weight")
    made = ((i, (k, h, rf"(?s:(?<=.))(?=({p}))", *rest)) for i, (k, h, p, *rest) in enumerate(rules()))
    return F.array(*(F.struct(F.lit(i).alias("place"), *(F.lit(v).alias(n) for n, v in zip(names, r, strict=True))) for i, r in made))


def _starts(pieces: Column) -> Column:
    """Characters at which the pieces but the first begin, counted from 1."""
    empty = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("starts"))

    def step(state: Column, piece: Column) -> Column:
        at = state["at"] + F.length(piece)
        return F.struct(at.alias("at"), F.array_append(state["starts"], at).alias("starts"))

    return F.aggregate(F.slice(pieces, 1, F.size(pieces) - 1), empty, step)["starts"]


def _detections(tile: Column, due: Column) -> Column:
    """All matches of the rules that begin in a tile, with the characters of the text they start and end at.

    A tile is cut before every character at which a rule matches, so that the lengths of the parts are the places.
    """
    text = tile["text"]
    cut = F.transform(due, lambda r: F.struct(r.alias("rule"), F.split(text, r["pattern"], -1).alias("pieces")))
    hits = F.filter(cut, lambda h: F.size(h["pieces"]) > 1)
    # The first character of a tile is the one before it.
    shift = tile["place"] * F.lit(TILE) - 1

    def placed(hit: Column) -> Column:
        rule = hit["rule"]
        matches = F.regexp_extract_all(text, rule["pattern"], F.lit(1))
        found = F.zip_with(_starts(hit["pieces"]), matches, lambda at, m: F.struct(at.alias("at"), F.length(m).alias("n")))
        return F.transform(
            F.filter(found, lambda f: f["at"] <= TILE + 1),
            lambda f: F.struct(
                (f["at"] + shift).alias("begin"), (f["at"] + f["n"] + shift).alias("end"), rule["place"].alias("place"),
                rule["priority"].alias("priority"), rule["label"].alias("label"), rule["weight"].alias("weight"),
            ),
        )

    return F.flatten(F.transform(hits, placed))


def _kept(detections: Column) -> Column:
    """Detections that no other one contains with a priority as high; earlier rules win equal places."""

    def beaten(d: Column, o: Column) -> Column:
        contains = (o["begin"] <= d["begin"]) & (o["end"] >= d["end"])
        same = (o["begin"] == d["begin"]) & (o["end"] == d["end"])
        return contains & ((same & (o["place"] < d["place"])) | (~same & (o["priority"] >= d["priority"])))

    return F.filter(detections, lambda d: ~F.exists(detections, lambda o: beaten(d, o)))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections``."""
    rows = text_rows(docs, id_col, text_col).select("doc_id", F.translate("text", UPPER, LOWER).alias("low"))
    words = F.trim(F.regexp_replace("low", NO_WORD, " "), F.lit(" "))
    rows = rows.withColumn("words", F.concat(F.lit(" "), words, F.lit(" ")))
    spaces = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    n_words = F.when(F.col("words") == "  ", F.lit(0)).otherwise(spaces(F.col("words")) - 1).cast("long")

    counts, firsts, lasts, base = [], [], [], []
    for phrase, label in BASE:
        padded, (head, _, tail) = f" {phrase} ", phrase.partition(" ")
        has = F.col("words").contains(padded)
        counts.append(F.when(has, F.regexp_count(F.col("words"), F.lit(f" {head}(?= {tail} )"))).otherwise(F.lit(0)))
        begin = F.instr("words", padded)
        back = F.instr(F.reverse("words"), padded[::-1])
        final = F.length("words") - back - len(padded) + 2
        firsts.append(F.when(has, spaces(F.substring(F.col("words"), F.lit(1), begin - 1))))
        lasts.append(F.when(has, spaces(F.substring(F.col("words"), F.lit(1), final - 1))))
        base.append(F.when(has, F.lit(label)))
    n_base = reduce(lambda a, b: a + b, counts).cast("long")

    keywords = sorted({r[0] for r in rules()})
    gate = "|".join(keywords)
    # Null without a keyword, so that white space is collapsed and tiles are cut only where one is.
    flat = F.when(F.col("low").rlike(gate), F.regexp_replace("low", BLANKS, " "))
    rows = rows.withColumn("pieces", F.regexp_extract_all(flat, F.lit(f"(?s).{{1,{TILE}}}"), F.lit(0)))

    def tile(piece: Column, i: Column) -> Column:
        # One character before the tile tells whether a word begins there; before the text it is a space.
        before = F.when(i > 0, F.right(F.get("pieces", i - 1), F.lit(1))).otherwise(" ")
        after = F.coalesce(F.left(F.get("pieces", i + 1), F.lit(REACH)), F.lit(""))
        return F.struct(F.concat(before, piece, after).alias("text"), i.alias("place"))

    rows = rows.withColumn("tiles", F.filter(F.transform("pieces", tile), lambda t: t["text"].rlike(gate)))
    rule_array = _rule_array()

    def of_tile(t: Column) -> Column:
        due = F.filter(rule_array, lambda r: F.contains(t["text"], r["keyword"]) & F.contains(t["text"], r["hint"]))
        return _detections(t, due)

    kind = "array<struct<begin:int,end:int,place:int,priority:int,label:string,weight:double>>"
    found = F.coalesce(F.flatten(F.transform("tiles", of_tile)), F.array().cast(kind)).cast(kind)
    judged = rows.select(
        "doc_id",
        n_words.alias("n_words"),
        n_base.alias("n_base"),
        F.least(*firsts).cast("long").alias("first_word"),
        F.greatest(*lasts).cast("long").alias("last_word"),
        F.array_compact(F.array(*base)).alias("base"),
        found.alias("found"),
    ).withColumn("detections", _kept(F.col("found")))
    labels = F.array_union(F.col("base"), F.transform("detections", lambda d: d["label"]))
    weights = F.concat(F.transform("detections", lambda d: d["weight"]), F.transform("base", lambda _: F.lit(0.7)))
    return judged.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(labels)), ",").alias("labels"),
        (1 - F.aggregate(weights, F.lit(1.0), lambda left, w: left * (1 - w))).alias("score"),
        "detections",
    )
