"""License scans: ordered signature rules over the words of a text, with DataFrame operations only.

A rule is a regex over words, a label, a priority (1 is strongest) and a keyword. Only texts that match the gate are
split into words at all, and of the rules only those are run whose family's name and whose keyword the text contains.
Detections of all rules are sorted by place; one that lies inside another of the same or a stronger priority is suppressed.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.llm.common import let

# Licence families: label, names in words, versions in words and as they are labelled, SPDX words.
FAMILIES: list[tuple[str, str, list[tuple[str, str]]]] = [
    ("afl", "academic free|afl", [("2 1", "2.1"), ("3 0", "3.0")]),
    ("agpl", "gnu affero general public|affero general public|gnu agpl|agpl", [("3 0|3|v3", "3.0")]),
    ("apache", "apache software|apache", [("1 1", "1.1"), ("2 0|2|v2", "2.0")]),
    ("apsl", "apple public source|apsl", [("2 0|2", "2.0")]),
    ("artistic", "perl artistic|artistic", [("1 0|1", "1.0"), ("2 0|2", "2.0")]),
    ("beerware", "beerware|beer ware", []),
    ("blueoak", "blue oak model|blue oak", [("1 0 0|1 0", "1.0.0")]),
    ("bsd-2-clause", "bsd 2 clause|2 clause bsd|simplified bsd|freebsd", []),
    ("bsd-3-clause", "bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd", []),
    ("bsd-4-clause", "bsd 4 clause|4 clause bsd|original bsd", []),
    ("bsd", "bsd", []),
    ("bsl", "boost software|boost", [("1 0|1", "1.0")]),
    ("busl", "business source|busl", [("1 1", "1.1")]),
    ("cc-by", "creative commons attribution|cc by", [("3 0", "3.0"), ("4 0", "4.0")]),
    ("cc-by-nc", "creative commons attribution non ?commercial|cc by nc", [("3 0", "3.0"), ("4 0", "4.0")]),
    ("cc-by-nc-nd", "cc by nc nd", [("3 0", "3.0"), ("4 0", "4.0")]),
    ("cc-by-nc-sa", "cc by nc sa", [("3 0", "3.0"), ("4 0", "4.0")]),
    ("cc-by-nd", "creative commons attribution no ?derivatives|cc by nd", [("3 0", "3.0"), ("4 0", "4.0")]),
    ("cc-by-sa", "creative commons attribution share ?alike|cc by sa", [("3 0", "3.0"), ("4 0", "4.0")]),
    ("cc0", "creative commons zero|cc zero|cc0", [("1 0", "1.0")]),
    ("cddl", "common development and distribution|cddl", [("1 0", "1.0"), ("1 1", "1.1")]),
    ("cecill", "cecill", [("2 1", "2.1")]),
    ("cpl", "common public", [("1 0", "1.0")]),
    ("ecl", "educational community", [("2 0", "2.0")]),
    ("edl", "eclipse distribution", [("1 0", "1.0")]),
    ("epl", "eclipse public|epl", [("1 0", "1.0"), ("2 0", "2.0")]),
    ("eupl", "european union public|eupl", [("1 1", "1.1"), ("1 2", "1.2")]),
    ("fdl", "gnu free documentation|gfdl", [("1 2", "1.2"), ("1 3", "1.3")]),
    ("ftl", "freetype", []),
    ("gpl", "gnu general public|general public|gnu gpl|gpl", [("1 0|1|v1", "1.0"), ("2 0|2|v2", "2.0"), ("3 0|3|v3", "3.0")]),
    ("icu", "icu", []),
    ("ijg", "independent jpeg group|ijg", []),
    ("isc", "internet systems consortium|isc", []),
    ("lgpl", "gnu lesser general public|lesser general public|gnu library general public|gnu lgpl|lgpl", [("2 0|2", "2.0"), ("2 1|v2 1", "2.1"), ("3 0|3|v3", "3.0")]),
    ("libpng", "libpng|png reference library", []),
    ("lppl", "latex project public|lppl", [("1 3c|1 3", "1.3")]),
    ("mit", "mit|expat|x11", []),
    ("mpl", "mozilla public|mpl", [("1 1", "1.1"), ("2 0|2", "2.0")]),
    ("ms-pl", "microsoft public|ms pl", []),
    ("ms-rl", "microsoft reciprocal|ms rl", []),
    ("mulan", "mulan permissive software|mulan psl", [("2|v2", "2.0")]),
    ("ncsa", "university of illinois ncsa|illinois ncsa|ncsa", []),
    ("odbl", "open database|odbl", [("1 0", "1.0")]),
    ("odc-by", "open data commons attribution|odc by", [("1 0", "1.0")]),
    ("ofl", "sil open font|open font|ofl", [("1 1", "1.1")]),
    ("openssl", "openssl", []),
    ("osl", "open software|osl", [("2 1", "2.1"), ("3 0", "3.0")]),
    ("php", "php", [("3 0", "3.0"), ("3 01", "3.01")]),
    ("postgresql", "postgresql", []),
    ("psf", "python software foundation|psf", [("2 0|2", "2.0")]),
    ("qpl", "q public", [("1 0", "1.0")]),
    ("ruby", "ruby", []),
    ("sspl", "server side public|sspl", [("1|1 0|v1", "1.0")]),
    ("unlicense", "unlicen[cs]e", []),
    ("upl", "universal permissive", [("1 0", "1.0")]),
    ("vim", "vim", []),
    ("w3c", "w3c software|w3c", []),
    ("wtfpl", "do what the fuck you want to public|wtfpl", [("2|v2", "2.0")]),
    ("zlib", "zlib libpng|zlib", []),
    ("zpl", "zope public|zpl", [("2 1", "2.1")]),
]
# Rules that name no family: label, words, priority, keyword.
SINGLE: list[tuple[str, str, int, str]] = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", 1, "granted"),
    ("isc", "permission to use copy modify and(?: or)? distribute this software for any purpose", 1, "distribute"),
    ("bsd", "redistribution and use in source and binary forms", 1, "redistribution"),
    ("zlib", "this software is provided as is without any express or implied warranty", 1, "warranty"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public", 1, "redistribute"),
    ("unlicense", "this is free and unencumbered software released into the public domain", 1, "unencumbered"),
    ("public-domain", "(?:dedicated to|released into|placed in|in) the public domain", 2, "public  domain"),
    ("cc0", "no copyright creative commons zero", 1, "copyright"),
    ("all-rights-reserved", "all rights reserved", 2, "reserved"),
    ("proprietary", "(?:proprietary|confidential) and (?:proprietary|confidential)", 2, "proprietary"),
    ("unspecified", "(?:licensed|released|distributed) under", 3, "under"),
    ("unspecified", "(?:see|read) the licen[cs]e(?: file)?", 3, "licen"),
]
BASE = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before lower-casing.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A text that holds none of these is not looked at further, as no rule can match it: each rule's keyword contains one
#: of the words, or is "under" after a verb that contains one or is named here.
GATE = ("licen", "spdx", "granted", "distribut", "warranty", "unencumbered", "domain", "copyright", "reserved", "proprietary")
UNDER = ("released", "available", "published")
CONFIDENCE = {1: 1.0, 2: 0.8, 3: 0.4}


def rules() -> list[tuple[str, str, int, str]]:
    """(pattern, label, priority, keyword) in order. Words are two spaces apart, so that neighbours never share one."""
    made: list[tuple[str, str, int, str]] = []
    for label, names, versions in FAMILIES:
        name = f"(?:{names})"
        for words, shown in versions:
            of = f"{label}-{shown}"
            made.append((f"(?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?{name}(?: licen[cs]e)?(?: version)? (?:{words})", of, 1, "under"))
            made.append((f"{name} licen[cs]e(?: version)? (?:{words})", of, 1, "licen"))
            made.append((f"spdx license identifier {name} (?:{words})", of, 1, "spdx"))
        made.append((f"spdx license identifier {name}", label, 2, "spdx"))
        made.append((f"(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of the )?{name}(?: licen[cs]e)?", label, 2, "under"))
        made.append((f"(?:dual|also) licensed (?:under )?(?:the )?{name}", label, 2, "licensed"))
        made.append((f"{name} licen[cs]ed?", label, 2, "licen"))
    made += [(words, label, priority, keyword) for label, words, priority, keyword in SINGLE]
    return [(" " + words.replace(" ", "  ") + " ", label, priority, keyword) for words, label, priority, keyword in made]


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literals(names: str) -> list[str]:
    """For each alternative of a family's name what any match spells out: the words up to the first sign with a meaning of its own."""
    found = []
    for name in names.split("|"):
        spelled = re.match(r"[a-z0-9 ]*", name)[0]
        whole = spelled == name
        # a sign that follows may make the last letter optional
        found.append(" " + (spelled if whole else spelled[:-1]).replace(" ", "  ") + (" " if whole else ""))
    return found


def gated() -> list[tuple[list[str], list[tuple[str, str, int, str, int]]]]:
    """The rules, with their numbers, by what one of must stand in a text for any of them to match."""
    per_label = {label: literals(names) for label, names, _ in FAMILIES}
    groups: dict[tuple[str, ...], list] = {}
    singles = len(rules()) - len(SINGLE)
    for i, (pattern, label, priority, keyword) in enumerate(rules()):
        family = next((f for f in (label, label.rsplit("-", 1)[0]) if f in per_label and i < singles), None)
        needed = per_label[family] if family else [keyword]
        groups.setdefault(tuple(needed), []).append((pattern, label, priority, keyword, i))
    return [(list(needed), made) for needed, made in groups.items()]


def _rules_column() -> Column:
    groups = []
    for needed, made in gated():
        rows = (f"named_struct('pattern', {_quoted(p)}, 'label', {_quoted(n)}, 'priority', {k}, 'keyword', {_quoted(w)}, 'ord', {i})" for p, n, k, w, i in made)
        groups.append(f"named_struct('needed', array({', '.join(map(_quoted, needed))}), 'rules', array({', '.join(rows)}))")
    return F.expr(f"array({', '.join(groups)})")


def _detections() -> str:
    """Of ``norm``, all matches of the active rules with their places in it, in order of place."""
    return r"""
    array_sort(flatten(transform(
        filter(flatten(transform(filter(rules, g -> exists(g.needed, w -> contains(norm, w))), g -> g.rules)), r -> contains(norm, r.keyword)), r ->
        transform(array(struct(regexp_extract_all(norm, r.pattern, 0) AS found, split(norm, r.pattern, -1) AS between)), m ->
            aggregate(sequence(1, greatest(size(m.found), 1)),
                named_struct('at', 0, 'all', cast(array() AS array<struct<start:int, stop:int, priority:int, ord:int, label:string>>)),
                (a, k) -> if(size(m.found) = 0, a, named_struct(
                    'at', a.at + length(m.between[k - 1]) + length(m.found[k - 1]),
                    'all', concat(a.all, array(named_struct('start', a.at + length(m.between[k - 1]), 'stop', a.at + length(m.between[k - 1]) + length(m.found[k - 1]), 'priority', r.priority, 'ord', r.ord, 'label', r.label))))),
                a -> a.all))[0])),
        (x, y) -> CASE WHEN x.start <> y.start THEN x.start - y.start WHEN x.stop <> y.stop THEN y.stop - x.stop
                       WHEN x.priority <> y.priority THEN x.priority - y.priority ELSE x.ord - y.ord END)"""


def _surviving() -> str:
    """Of ``found``, those that no earlier one of the same or a stronger priority contains: one pass with the furthest ends."""
    return """
    aggregate(found,
        named_struct('e1', -1, 'e2', -1, 'e3', -1, 'kept', cast(array() AS array<struct<start:int, stop:int, priority:int, ord:int, label:string>>)),
        (a, d) -> named_struct(
            'e1', if(d.priority = 1, greatest(a.e1, d.stop), a.e1),
            'e2', if(d.priority = 2, greatest(a.e2, d.stop), a.e2),
            'e3', if(d.priority = 3, greatest(a.e3, d.stop), a.e3),
            'kept', if(a.e1 >= d.stop OR (d.priority >= 2 AND a.e2 >= d.stop) OR (d.priority = 3 AND a.e3 >= d.stop), a.kept, concat(a.kept, array(d)))),
        a -> a.kept)"""


def _places(phrase: str) -> str:
    parts = phrase.split(" ")
    same = " AND ".join(f"words[i + {k}] = '{w}'" for k, w in enumerate(parts))
    return f"if(size(words) >= {len(parts)}, filter(sequence(0, greatest(size(words) - {len(parts)}, 0)), i -> {same}), cast(array() AS array<int>))"


def _may_match(lowered: Column) -> Column:
    return let(
        lowered,
        lambda t: reduce(Column.__or__, [F.contains(t, F.lit(w)) for w in GATE])
        | (F.contains(t, F.lit("under")) & reduce(Column.__or__, [F.contains(t, F.lit(w)) for w in UNDER])),
    )


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; other columns ignored): counts, places and labels of licence texts.

    n_words; base places (``places`` of the phrases of BASE, n_base, first_word, last_word, base_labels); the surviving
    detections of the rules (``detections``: character places in the words joined by two spaces, priority, label);
    labels of both; score, the confidence of the strongest. Null and empty texts have no words and no labels, repeated
    rows are scanned each on its own, an empty table gives none. No row moves.
    """
    none = "cast(array() AS array<struct<start:int, stop:int, priority:int, ord:int, label:string>>)"
    phrases = ", ".join(f"named_struct('label', '{label}', 'at', {_places(phrase)})" for label, phrase in BASE.items())
    whole = f"""
    transform(array(filter(split(translate(text, '{UPPER}', '{LOWER}'), {_quoted(NOT_WORD)}), w -> w <> '')), words ->
        transform(array(concat(' ', array_join(words, '  '), ' ')), norm ->
            transform(array({_detections()}), found -> named_struct(
                'base', array({phrases}),
                'kept', {_surviving()}))[0])[0])[0]"""
    text = F.coalesce("text", F.lit(""))
    seen = (
        docs.select("doc_id", text.alias("text"), _rules_column().alias("rules"))
        .select(
            "doc_id",
            F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"),
            F.when(_may_match(F.lower("text")), F.expr(whole)).alias("seen"),
        )
        .select(
            "doc_id",
            "n_words",
            F.expr(f"coalesce(seen.kept, {none})").alias("detections"),
            F.expr("coalesce(filter(seen.base, b -> size(b.at) > 0), array())").alias("base"),
        )
        .select("*", F.expr("array_sort(flatten(transform(base, b -> b.at)))").alias("places"))
    )
    labels = "array_sort(array_distinct(concat(transform(base, b -> b.label), transform(detections, d -> d.label))))"
    strongest = "array_min(concat(transform(detections, d -> d.priority), if(size(base) > 0, array(1), cast(array() AS array<int>))))"
    return seen.select(
        "doc_id",
        "n_words",
        F.expr("cast(size(places) AS bigint)").alias("n_base"),
        F.expr("cast(get(places, 0) AS bigint)").alias("first_word"),
        F.expr("cast(get(places, size(places) - 1) AS bigint)").alias("last_word"),
        F.expr("array_join(array_sort(transform(base, b -> b.label)), ',')").alias("base_labels"),
        F.expr(f"array_join({labels}, ',')").alias("labels"),
        F.coalesce(*[F.when(F.expr(strongest) == k, F.lit(v)) for k, v in CONFIDENCE.items()], F.lit(0.0)).alias("score"),
        "places",
        "detections",
    )
