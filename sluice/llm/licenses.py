"""Licence scans: Dice coefficient over word bigrams against templates.

A document's units (its lines, its paragraphs, the whole text) are normalised
to lower-case words and compared to licence templates by the Dice coefficient
of their word-bigram sets. A template is only compared to units whose number
of bigrams could reach the threshold. So that notices within longer lines or
paragraphs are found, it is also compared to the windows of the whole text's
words, of at most so many bigrams, that begin and end with one of its bigrams:
cutting other bigrams off the ends raises the coefficient. Versions and clauses
must agree: a unit has the bigrams that tell a template from its relatives, and
none that deny it. Clauses in which a denial ("no longer", "used to be", "not")
comes before a licence's verb are cut out first, from the denial to their end.
All of it is expressions on the row.

Units need an anchor word to be looked at: each template's anchors are words
that cover so many of its bigrams that no unit without any of them can reach
the threshold. This drops no match.

Defined cases: null, empty and wordless texts have no licence; whole texts are
searched, however long; of equal coefficients the longer template wins, then the
first by name; repeated rows are scanned each; other columns of
the input are ignored.
"""

from __future__ import annotations

import functools
import math
import operator
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
#: Public licence notices, as templates.
TEMPLATES = {
    "agpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "cc-by-3.0": "This work is licensed under a Creative Commons Attribution 3.0 Unported License.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-4.0-short": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-4.0-text": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc-by-sa-3.0-text": "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.",
    "cc-by-sa-4.0-text": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0": "This work is released into the public domain under CC0 1.0 Universal.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "lgpl-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl-3.0-header": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mit": "Released under the MIT License.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "gpl-2.0-only-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "lgpl-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "lgpl-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "agpl-3.0-short": "This work is licensed under the GNU Affero General Public License, version 3.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
}

#: Elements of the Creative Commons licences, in words; each comes in a short and a long notice of both current versions.
ELEMENTS = {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nc": "Attribution-NonCommercial", "by-nd": "Attribution-NoDerivatives", "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}
#: Identifiers that one-line notices name.
SPDX = ("MIT", "ISC", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "CC0-1.0", "Unlicense")


def _made() -> tuple[dict[str, str], dict[str, tuple[str, ...]]]:
    """The notices that follow a form, but those stated, and the bigrams of their names, which a unit must have."""
    texts, needs = {}, {}
    for element, words in ELEMENTS.items():
        for version, edition in (("3.0", "Unported"), ("4.0", "International")):
            tail = words.lower().split("-")
            for name, text, told in (
                (f"cc-{element}-{version}", f"Licensed under CC {element.upper()} {version}.", f"cc {element} {version}"),
                (f"cc-{element}-{version}-text", f"This work is licensed under a Creative Commons {words} {version} {edition} License.", f"{' '.join(tail)} {version}"),
            ):
                if text not in TEMPLATES.values():
                    name = f"{name}-short" if name in TEMPLATES else name
                    texts[name], needs[name] = text, tuple(sorted(word_bigrams(told)))
    for name in SPDX:
        texts[f"{name.lower()}-spdx"], needs[f"{name.lower()}-spdx"] = f"SPDX-License-Identifier: {name}", tuple(sorted(word_bigrams(f"identifier {name}")))
    return texts, needs


#: Bigrams that tell a template from its relatives: versions and clauses that a unit must have.
REQUIRED = {
    "agpl-3.0": ("affero general", "version 3"),
    "apache-2.0": ("apache license", "version 2"),
    "apache-2.0-header": ("apache license", "version 2"),
    "bsd-2-clause": ("following conditions",),
    "bsd-3-clause": ("neither the",),
    "cc-by-3.0": ("attribution 3",),
    "cc-by-4.0": ("attribution 4",),
    "cc-by-4.0-short": ("by 4",),
    "cc-by-nc-4.0": ("by nc", "nc 4"),
    "cc-by-nc-4.0-text": ("attribution noncommercial", "noncommercial 4"),
    "cc-by-sa-3.0-text": ("attribution sharealike", "sharealike 3"),
    "cc-by-sa-4.0": ("by sa", "sa 4"),
    "cc-by-sa-4.0-text": ("attribution sharealike", "sharealike 4"),
    "cc0-1.0": ("cc0 1",),
    "gpl-2.0": ("gnu general", "version 2"),
    "gpl-2.0-header": ("gnu general", "version 2"),
    "gpl-3.0": ("gnu general", "version 3"),
    "gpl-3.0-header": ("gnu general", "version 3"),
    "lgpl-2.1-header": ("lesser general", "2 1"),
    "lgpl-3.0-header": ("lesser general", "version 3"),
    "mit": ("mit license",),
    "mpl-2.0": ("mozilla public", "2 0"),
    "gpl-2.0-only-header": ("gnu general", "license version", "version 2", "2 as"),
    "lgpl-2.1": ("lesser general", "2 1"),
    "lgpl-3.0": ("lesser general", "version 3"),
    "agpl-3.0-short": ("affero general", "version 3"),
    "unlicense": ("unencumbered software",),
}
#: Bigrams that a template's unit, or a window and its surroundings, may not have: other clauses and denials.
FORBIDDEN = {"bsd": ("neither the",), "bsd-2-clause": ("neither the",)}
DENIED = ("granted", "licensed", "permitted", "released")
#: From a denial on, a clause about a licence is not looked at: up to its end, which a dot within a number or name is not.
DENIAL = (
    r"\b(?:no longer|used to be|formerly|previously|never|not|cannot|isn.t|aren.t|wasn.t|won.t)\b[^.!?;\n]{0,40}?\b(?:released|licensed|granted|permitted|distributed|available)\b"
    r"(?:[^.!?;\n]|\.[0-9a-z]){0,300}"
)
#: Bigrams before and after a window in which a denial or another clause counts.
DENIAL_REACH = 6
#: Templates that are a part of others, and are not listed beside them.
WITHIN = {"apache-2.0": ("apache-2.0-header",), "bsd": ("bsd-2-clause", "bsd-3-clause"), "bsd-2-clause": ("bsd-3-clause",)}


def forbidden(name: str, grams: set[str]) -> tuple[str, ...]:
    """Bigrams that speak against a template: those stated and denials of its verbs."""
    words = {w for g in grams for w in g.split()}
    return (*FORBIDDEN.get(name, ()), *(f"{no} {verb}" for verb in DENIED if verb in words for no in ("never", "not")))


#: Words that are poor anchors.
COMMON = frozenset("0 1 2 3 4 a above all an and any as by copy fee following for free hereby http in is later may mit not of or other out permit person provided that the this to under use used whom with work www you your".split())


def word_bigrams(text: str) -> set[str]:
    """The bigram set of a template; texts are cut the same way by :func:`_pairs`."""
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return {f"{a} {b}" for a, b in zip(words, words[1:])}


_MORE = _made()
TEMPLATES |= _MORE[0]
REQUIRED |= _MORE[1]


def anchor_words(grams: set[str], threshold: float) -> list[str]:
    """Words of which every unit that reaches the threshold has at least one.

    Common words are only taken when the others cannot cover enough bigrams.
    """
    need = math.ceil(threshold / (2 - threshold) * len(grams) - 1e-9)
    covered, anchors = set(), []
    while len(covered) < len(grams) - need + 1:
        words = sorted({w for g in grams - covered for w in g.split()})
        best = max(words, key=lambda w: (w not in COMMON, sum(w in g.split() for g in grams - covered) * min(len(w), 6), len(w)))
        anchors.append(best)
        covered |= {g for g in grams if best in g.split()}
    return anchors


def _pairs(words: Column) -> Column:
    return F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.concat_ws(" ", a, b))


def _known(templates: dict[str, str], threshold: float) -> Column:
    """The templates as one array: name, bigrams, least and most bigrams of a unit, what it needs and what bars it."""
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    texts = lambda items: F.array(*map(F.lit, items)).cast("array<string>")
    found = []
    for name, text in sorted(templates.items()):
        grams = word_bigrams(text)
        few, many = math.ceil(low * len(grams) - 1e-9), math.floor(high * len(grams) + 1e-9)
        within = WITHIN.get(name, ())
        found.append(F.struct(F.lit(name).alias("name"), texts(sorted(grams)).alias("grams"), F.lit(few).alias("few"), F.lit(many).alias("many"), texts(REQUIRED.get(name, ())).alias("needs"), texts(forbidden(name, grams)).alias("bars"), texts(within).alias("within")))
    return F.array(*found)


def _agrees(t: Column, grams: Column, near: Column) -> Column:
    """A unit has all that the template needs, and nothing in or near it speaks against it."""
    return (F.size(F.array_except(t["needs"], grams)) == 0) & ~F.arrays_overlap(near, t["bars"])


def _dice(t: Column, grams: Column) -> Column:
    return F.lit(2.0) * F.size(F.array_intersect(grams, t["grams"])) / (F.size(grams) + F.size(t["grams"]))


def _in_windows(t: Column, grams: Column) -> Column:
    """The best coefficient of a text's windows that begin and end with a bigram of the template."""
    at = F.filter(F.sequence(F.lit(1), F.size(grams)), lambda i: F.array_contains(t["grams"], F.element_at(grams, i)))

    def coefficient(a: Column, b: Column) -> Column:
        window = F.array_distinct(F.slice(grams, a, b - a + 1))
        begin = F.greatest(a - DENIAL_REACH, F.lit(1))
        near = F.slice(grams, begin, b - begin + 1 + DENIAL_REACH)
        return F.when((b - a < t["many"]) & _agrees(t, window, near), _dice(t, window))

    def best(places: Column) -> Column:
        # a window that reaches the threshold has at least the template's least number of its bigrams
        ends = lambda k: F.slice(places, k + t["few"], t["many"])
        begins = F.sequence(F.lit(0), F.size(places) - t["few"])
        of_begin = lambda k: F.array_max(F.transform(ends(k), lambda b: coefficient(F.get(places, k), b)))
        return F.when(F.size(places) >= t["few"], F.array_max(F.transform(begins, of_begin)))

    # the places are worked out once
    return F.get(F.transform(F.array(at), best), F.lit(0))


def scanned(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license, dice and matches (every template that reached ``threshold``)."""
    given = templates or TEMPLATES
    sets = [word_bigrams(text) for text in given.values()]
    anchors = sorted({w for g in sets for w in anchor_words(g, threshold)})
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    least, most = min(math.ceil(low * len(g) - 1e-9) for g in sets), max(math.floor(high * len(g) + 1e-9) for g in sets)

    def anchored(text: Column, mark: str) -> Column:
        return functools.reduce(operator.or_, [F.contains(text, F.lit(f"{mark}{w}{mark}")) for w in anchors])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col("text").cast("string")).alias("text"))
    rows = rows.select("doc_id", F.when(anchored(F.col("text"), ""), F.regexp_replace(F.regexp_replace("text", DENIAL, " "), r"[^a-z0-9\n]+", " ")).alias("text"))
    units = F.array_distinct(F.concat(F.split("text", r"\n"), F.split("text", r"\n\x20*\n"), F.array("text")))
    plain = F.concat(F.lit(" "), F.regexp_replace("text", r"[\x20\n]+", " "), F.lit(" "))
    rows = rows.select("doc_id", plain.alias("plain"), F.transform(units, lambda u: F.concat(F.lit(" "), F.regexp_replace(u, r"[\x20\n]+", " "), F.lit(" "))).alias("units"))
    rows = rows.select("doc_id", F.when(anchored(F.col("plain"), " "), F.split(F.trim("plain"), " ")).alias("words"), F.filter("units", lambda u: (F.length(u) >= 2 * least + 1) & anchored(u, " ")).alias("units"))
    rows = rows.select("doc_id", F.when(F.size("words") > least, _pairs(F.col("words"))).alias("grams"), F.transform("units", lambda u: F.split(F.trim(u), " ")).alias("units"))
    # only templates that the whole text has enough of are compared at all
    enough = F.filter(_known(given, threshold), lambda t: F.size(F.array_intersect("grams", t["grams"])) >= t["few"])
    rows = rows.select("doc_id", "grams", "units", F.when(F.col("grams").isNotNull(), enough).alias("known"))
    rows = rows.select("doc_id", "grams", "known", F.when(F.size("known") > 0, F.transform(F.filter("units", lambda w: F.size(w) > least), lambda w: F.array_distinct(_pairs(w)))).alias("units"))
    rows = rows.select("doc_id", "grams", "known", F.filter("units", lambda g: F.size(g).between(least, most)).alias("units"))

    def hit(t: Column) -> Column:
        fit = F.filter("units", lambda g: F.size(g).between(t["few"], t["many"]) & _agrees(t, g, g))
        best = F.greatest(F.array_max(F.transform(fit, lambda g: _dice(t, g))), _in_windows(t, F.col("grams")))
        return F.struct((-best).alias("order"), (-F.size(t["grams"])).alias("size"), t["name"].alias("name"), t["within"].alias("within"))

    hits = F.array_sort(F.filter(F.transform("known", hit), lambda h: -h["order"] >= threshold))
    rows = rows.select("doc_id", F.when(F.size("known") > 0, hits).alias("hits"))
    rows = rows.select("doc_id", F.filter("hits", lambda h: ~F.exists("hits", lambda o: F.array_contains(h["within"], o["name"]))).alias("hits"))
    return rows.select(
        "doc_id", F.get("hits", F.lit(0))["name"].alias("license"), F.coalesce(F.round(-F.get("hits", F.lit(0))["order"], 6), F.lit(0.0)).alias("dice"),
        F.coalesce(F.array_join(F.transform("hits", lambda h: h["name"]), ","), F.lit("")).alias("matches"),
    )
