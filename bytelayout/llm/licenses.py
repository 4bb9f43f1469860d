"""License detection by ordered signature rules over folded words.

A rule is a regular expression over the words of a text, lower-cased and joined by
single blanks, with a priority and keywords. One automaton over all keywords reads
each text once; only rules whose keywords all begin a word are tried. A detection that lies
within one of a higher priority, or within a longer one of the same priority, is
suppressed. Base phrases are never suppressed.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from bytelayout.llm.rows import FOLD, held_by_worker, id_and_text, map_texts

BASE_PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)


@dataclass(frozen=True)
class Rule:
    """`keywords`: groups of words; at least one of each group begins a word of every match."""

    label: str
    pattern: str
    priority: int
    keywords: tuple[tuple[str, ...], ...]
    base: bool = False


GNU = "(?:gnu )?"
VERSION = "(?: public)?(?: licen[cs]e)?(?: ?v| version)? ?"
# Label, how the license is named, SPDX identifier as words, and words one of which any name holds.
NAMES: tuple[tuple[str, str, str, tuple[str, ...]], ...] = (
    ("mit", "mit(?: expat)?", "mit", ("mit",)),
    ("expat", "expat", "expat", ("expat",)),
    ("mit-0", "mit (?:0|no attribution|zero)", "mit 0", ("mit",)),
    ("apache-1", "apache(?: software)?(?: licen[cs]e)?(?: v| version)? ?1(?: [01])?", "apache 1 [01]", ("apache",)),
    ("apache-2", "apache(?: software)?(?: licen[cs]e)?(?: v| version)? ?2(?: 0)?", "apache 2 0", ("apache",)),
    ("bsd-2", "(?:simplified bsd|freebsd|2 clause bsd|two clause bsd|bsd 2(?: clause)?)", "bsd 2 clause", ("bsd", "freebsd")),
    ("bsd-3", "(?:(?:new|modified|revised|3 clause|three clause) bsd|bsd 3(?: clause)?)", "bsd 3 clause", ("bsd",)),
    ("bsd-4", "(?:(?:original|4 clause|four clause) bsd|bsd 4(?: clause)?)", "bsd 4 clause", ("bsd",)),
    ("bsd-0", "(?:zero clause bsd|0bsd|bsd zero clause)", "0bsd", ("bsd", "0bsd")),
    ("isc", "isc", "isc", ("isc",)),
    ("gpl-1", f"(?:{GNU}gpl|gnu general){VERSION}1(?: 0)?", "gpl 1 0(?: only| or later)?", ("gpl", "gnu")),
    ("gpl-2", f"(?:{GNU}gpl|gnu general){VERSION}2(?: 0)?", "gpl 2 0(?: only| or later)?", ("gpl", "gnu")),
    ("gpl-3", f"(?:{GNU}gpl|gnu general){VERSION}3(?: 0)?", "gpl 3 0(?: only| or later)?", ("gpl", "gnu")),
    ("lgpl-2", f"(?:{GNU}lgpl|gnu (?:lesser|library) general){VERSION}2(?: [01])?", "lgpl 2 [01](?: only| or later)?", ("lgpl", "gnu")),
    ("lgpl-3", f"(?:{GNU}lgpl|gnu lesser general){VERSION}3(?: 0)?", "lgpl 3 0(?: only| or later)?", ("lgpl", "gnu")),
    ("agpl-3", f"(?:{GNU}agpl|gnu affero general){VERSION}3(?: 0)?", "agpl 3 0(?: only| or later)?", ("agpl", "affero")),
    ("gfdl-1", "(?:gfdl|gnu free documentation)(?: licen[cs]e)?(?: version)? ?1(?: [123])?", "gfdl 1 [123](?: only| or later)?", ("gfdl", "gnu")),
    ("mpl-1", "(?:mpl|mozilla public)(?: licen[cs]e)?(?: v| version)? ?1(?: [01])?", "mpl 1 [01]", ("mpl", "mozilla")),
    ("mpl-2", "(?:mpl|mozilla public)(?: licen[cs]e)?(?: v| version)? ?2(?: 0)?", "mpl 2 0", ("mpl", "mozilla")),
    ("epl-1", "(?:epl|eclipse public)(?: licen[cs]e)?(?: v| version)? ?1(?: 0)?", "epl 1 0", ("epl", "eclipse")),
    ("epl-2", "(?:epl|eclipse public)(?: licen[cs]e)?(?: v| version)? ?2(?: 0)?", "epl 2 0", ("epl", "eclipse")),
    ("eupl", "(?:eupl|european union public)(?: licen[cs]e)?(?: version)?(?: ?1 [12])?", "eupl 1 [12]", ("eupl", "european")),
    ("cddl", "(?:cddl|common development and distribution)", "cddl 1 [01]", ("cddl", "distribution")),
    ("cpl", "(?:cpl|common public)", "cpl 1 0", ("cpl", "common")),
    ("artistic-1", "artistic(?: licen[cs]e)?(?: version)? ?1(?: 0)?", "artistic 1 0", ("artistic",)),
    ("artistic-2", "artistic(?: licen[cs]e)?(?: version)? ?2(?: 0)?", "artistic 2 0", ("artistic",)),
    ("zlib", "(?:zlib|zlib libpng)", "zlib", ("zlib",)),
    ("boost", "boost(?: software)?", "bsl 1 0", ("boost", "bsl")),
    ("unlicense", "unlicense", "unlicense", ("unlicense",)),
    ("wtfpl", "wtfpl", "wtfpl", ("wtfpl",)),
    ("python-2", "(?:psf|python(?: software foundation)?)", "python 2 0", ("psf", "python")),
    ("ruby", "ruby", "ruby", ("ruby",)),
    ("openssl", "openssl", "openssl", ("openssl",)),
    ("x11", "x11", "x11", ("x11",)),
    ("ofl", "(?:ofl|sil open font)(?: licen[cs]e)?(?: version)?(?: ?1 1)?", "ofl 1 1", ("ofl", "sil")),
    ("ms-pl", "(?:ms pl|microsoft public)", "ms pl", ("ms", "microsoft")),
    ("ms-rl", "(?:ms rl|microsoft reciprocal)", "ms rl", ("ms", "microsoft")),
    ("odbl", "(?:odbl|open database)", "odbl 1 0", ("odbl", "database")),
    ("pddl", "(?:pddl|public domain dedication and)", "pddl 1 0", ("pddl", "dedication")),
    ("odc-by", "(?:odc by|open data commons attribution)", "odc by 1 0", ("odc", "commons")),
    ("cc0", "(?:cc0|cc zero|creative commons zero)", "cc0 1 0", ("cc0", "zero")),
    ("cc-by", "(?:cc by|creative commons attribution)(?: [1234] [05])?", "cc by [1234] [05]", ("cc", "creative")),
    ("cc-by-sa", "(?:cc by sa|creative commons attribution sharealike|creative commons attribution share alike)", "cc by sa [1234] [05]", ("cc", "creative")),
    ("cc-by-nd", "(?:cc by nd|creative commons attribution noderivs|creative commons attribution no derivatives)", "cc by nd [1234] [05]", ("cc", "creative")),
    ("cc-by-nc", "(?:cc by nc|creative commons attribution noncommercial|creative commons attribution non commercial)", "cc by nc [1234] [05]", ("cc", "creative")),
    ("cc-by-nc-sa", "(?:cc by nc sa|creative commons attribution noncommercial sharealike)", "cc by nc sa [1234] [05]", ("cc", "creative")),
    ("cc-by-nc-nd", "(?:cc by nc nd|creative commons attribution noncommercial noderivs)", "cc by nc nd [1234] [05]", ("cc", "creative")),
    ("bsl-1.1", "business source", "busl 1 1", ("business", "busl")),
    ("sspl", "(?:sspl|server side public)", "sspl 1 0", ("sspl", "server")),
    ("elastic-2", "elastic(?: licen[cs]e)? ?2(?: 0)?", "elastic 2 0", ("elastic",)),
    ("openrail", "(?:open ?rail|creativeml open ?rail m)", "openrail", ("openrail", "rail")),
    ("postgresql", "postgresql", "postgresql", ("postgresql",)),
    ("ncsa", "(?:ncsa|university of illinois ncsa)(?: open source)?", "ncsa", ("ncsa",)),
)

# How a text says that a license holds: words around the name, priority, and words one of which occurs.
FORMS: tuple[tuple[str, int, tuple[str, ...]], ...] = (
    ("spdx licen[cs]e identifier {spdx}", 95, ("spdx",)),
    ("(?:licen[cs]ed|released|distributed|available|published|provided|shared|governed|covered|offered)(?: \\S+)? under (?:the )?(?:terms of (?:the )?)?{name}(?: licen[cs]e)?", 80, ("under",)),
    ("subject to (?:the )?(?:terms (?:and conditions )?of (?:the )?)?{name}(?: licen[cs]e)?", 75, ("subject",)),
    ("{name} licen[cs]ed?", 60, ("license", "licence", "licensed", "licenced")),
    ("(?:licen[cs]e|licen[cs]ing|licen[cs]es) (?:is |type |name |the )?{name}", 50, ("license", "licence", "licensing", "licencing", "licenses", "licences")),
)

# Sentences of the license texts themselves, and notices without a license's name.
TEXTS: tuple[tuple[str, str, int, tuple[str, ...]], ...] = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", 90, ("hereby",)),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies", 85, ("copyright",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 90, ("hereby",)),
    ("bsd-2", "redistribution and use in source and binary forms with or without modification are permitted", 70, ("redistribution",)),
    ("bsd-3", "neither the name of .{1,80}? nor the names of its contributors may be used to endorse", 90, ("neither",)),
    ("bsd-4", "all advertising materials mentioning features or use of this software must display", 92, ("advertising",)),
    ("apache-2", "you may not use this file except in compliance with the license", 70, ("compliance",)),
    ("gpl-2", "either version 2 of the license or at your option any later version", 85, ("option",)),
    ("gpl-3", "either version 3 of the license or at your option any later version", 85, ("option",)),
    ("lgpl-2", "either version 2 1 of the license or at your option any later version", 86, ("option",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", 92, ("mozilla",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", 80, ("warranty",)),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy", 90, ("organization",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", 92, ("unencumbered",)),
    ("wtfpl", "do what the fuck you want to public license", 92, ("want",)),
    ("public-domain", "(?:released|dedicated|placed|is) (?:in|into|to) the public domain", 55, ("domain",)),
    ("cc0", "to the extent possible under law .{1,80}? has waived all copyright and related", 88, ("waived",)),
    ("ofl", "reserved font name", 60, ("font",)),
    ("proprietary", "all rights reserved", 40, ("rights",)),
    ("proprietary", "proprietary and confidential", 55, ("proprietary",)),
    ("non-commercial", "for (?:personal and )?non ?commercial (?:use|purposes) only", 55, ("commercial", "noncommercial")),
    ("copyright", "copyright (?:c )?(?:19|20)[0-9]{2}", 30, ("copyright",)),
    ("licence-mention", "(?:see|read) the (?:accompanying )?licen[cs]e(?: file)?", 20, ("license", "licence")),
)


def rules() -> tuple[Rule, ...]:
    """Base phrases, then sentences, then every license in every form: the order decides ties."""
    made = [Rule(label, phrase, 100, ((phrase.split()[-1],), (phrase.split()[0],)), True) for label, phrase in BASE_PHRASES]
    made += [Rule(label, text, priority, (words,)) for label, text, priority, words in TEXTS]
    for label, name, spdx, words in NAMES:
        for form, priority, form_words in FORMS:
            own = (re.sub(r"[^a-z0-9].*", "", spdx),) if "{spdx}" in form else words
            made.append(Rule(label, form.format(name=name, spdx=spdx), priority, (own, form_words)))
    return tuple(made)


class Scanner:
    def __init__(self, ruleset: Sequence[Rule]) -> None:
        self.rules = [(rule, re.compile(f"(?<= )(?:{rule.pattern})(?= )")) for rule in ruleset]
        self.needs: list[list[frozenset[str]]] = [[frozenset(group) for group in rule.keywords] for rule in ruleset]
        self.by_word: dict[str, list[int]] = {}
        for at, groups in enumerate(self.needs):
            for word in groups[0]:
                self.by_word.setdefault(word, []).append(at)
        self.words = ahocorasick.Automaton()
        # Open at the end: a pattern may join a version to a name ("lgplv3", "apache2").
        for word in {word for groups in self.needs for group in groups for word in group}:
            self.words.add_word(f" {word}", word)
        self.words.make_automaton()

    def detect(self, folded: str) -> list[tuple[int, int, Rule]]:
        """All detections of all rules, as characters of the folded text."""
        present = {word for _, word in self.words.iter(folded)}
        tried = {at for word in present for at in self.by_word.get(word, ())}
        found = []
        for at in sorted(tried):
            if all(not present.isdisjoint(group) for group in self.needs[at]):
                rule, pattern = self.rules[at]
                found += [(match.start(), match.end(), rule) for match in pattern.finditer(folded)]
        return found


def resolve(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Detections that stay, by place. What contains a detection comes before it in the order of the sweep."""
    ranked = sorted(range(len(found)), key=lambda at: (-found[at][2].priority, found[at][0] - found[at][1], at))
    rank = {at: place for place, at in enumerate(ranked)}
    kept, open_now = [], []
    for at in sorted(range(len(found)), key=lambda at: (found[at][0], -found[at][1], rank[at])):
        start, end, rule = found[at]
        open_now = [other for other in open_now if found[other][1] > start]
        inside = any(found[other][1] >= end and rank[other] < rank[at] for other in open_now)
        if rule.base or not inside:
            kept.append(found[at])
        open_now.append(at)
    return kept


def scanner(ruleset: tuple[Rule, ...]) -> Scanner:
    return held_by_worker(("licenses", ruleset), lambda: Scanner(ruleset))


FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("detections", T.ArrayType(T.StructType([
        T.StructField("label", T.StringType()), T.StructField("first_word", T.LongType()),
        T.StructField("end_word", T.LongType()), T.StructField("priority", T.IntegerType()),
        T.StructField("base", T.BooleanType()),
    ]))),
]


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ruleset: tuple[Rule, ...] | None = None
) -> DataFrame:
    """One row per row of `docs`: `doc_id`, `n_words`, `detections` in order of place.

    Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased; places
    are words from 0, the end excluded. Equal detections of one label appear as often as
    rules of that label find them and none of them outranks the other. Null and empty
    texts have no words and no detections.
    """
    ruleset = rules() if ruleset is None else ruleset

    def each() -> Callable[[list[bytes]], list[list]]:
        scan = scanner(ruleset)

        def batch(texts: list[bytes]) -> list[list]:
            counts, detections = [], []
            for text in texts:
                words = text.translate(FOLD).split()
                folded = b" " + b" ".join(words) + b" "
                counts.append(len(words))
                kept = resolve(scan.detect(folded.decode("latin-1")))
                if kept:
                    blanks = np.flatnonzero(np.frombuffer(folded, np.uint8) == 0x20)
                    first = np.searchsorted(blanks, [start - 1 for start, _, _ in kept])
                    last = np.searchsorted(blanks, [end for _, end, _ in kept])
                    detections.append([
                        {"label": rule.label, "first_word": int(a), "end_word": int(b), "priority": rule.priority, "base": rule.base}
                        for (_, _, rule), a, b in zip(kept, first, last, strict=True)
                    ])
                else:
                    detections.append([])
            return [counts, detections]

        return batch

    return map_texts(id_and_text(docs, id_col, text_col), FIELDS, each)
