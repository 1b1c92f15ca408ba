"""Licence scans by sentence rules.

A text is cut into sentences, each is normalised (lower case, letters and digits only) and looked up among known licence
sentences.  What is left of a text is a sequence of sentence identifiers; it is matched against ordered rules, each of
which names a licence and the identifiers that must follow one another, with at most a few sentences of other text
between two of them.  A longer rule wins over the rules that it contains.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordinalia.llm.common import text_of, without

#: Sentences of public licence texts and notices (fixed values); an identifier may stand for several wordings.
SENTENCES: dict[str, tuple[str, ...]] = {
    "apache2-notice": (
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License)",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License",
        "This project is licensed under the Apache License, Version 2.0",
    ),
    "apache2-compliance": ("you may not use this file except in compliance with the License",),
    "apache2-copy": ("You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",),
    "apache2-warranty": (
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
        "on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    ),
    "mit-notice": ("Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License"),
    "mit-title": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions",
    ),
    "mit-condition": (
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    ),
    "as-is-mit": (
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    ),
    "isc-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies",
    ),
    "bsd-grant": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
    ),
    "bsd-source": (
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    ),
    "bsd-binary": (
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
        "disclaimer in the documentation and/or other materials provided with the distribution",
    ),
    "bsd-endorse": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission",
    ),
    "gpl3-notice": (
        "This work is licensed under the GNU General Public License, version 3",
        "Licensed under the GNU General Public License, version 3",
        "Licensed under the GPL v3",
    ),
    "gpl-free": ("This program is free software",),
    "gpl-redistribute-2": (
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
        "Software Foundation, either version 2 of the License, or (at your option) any later version",
    ),
    "gpl-redistribute-3": (
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
        "Software Foundation, either version 3 of the License, or (at your option) any later version",
    ),
    "gpl-warranty": (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
        "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    ),
    "ccbync4-notice": (
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ),
    "ccby4-notice": (
        "Licensed under CC BY 4.0",
        "This work is licensed under CC BY 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
    ),
    "ccbysa4-notice": (
        "Licensed under CC BY-SA 4.0",
        "This work is licensed under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ),
    "mpl2-notice": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",),
    "cc0-notice": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",),
}
#: Licence and the identifiers that it needs in this order.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Apache-2.0", ("apache2-notice", "apache2-copy", "apache2-warranty")),
    ("Apache-2.0", ("apache2-notice",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("MIT", ("mit-title", "mit-grant", "mit-condition", "as-is-mit")),
    ("MIT", ("mit-grant", "mit-condition")),
    ("MIT", ("mit-notice",)),
    ("ISC", ("isc-grant",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-redistribute-3", "gpl-warranty")),
    ("GPL-3.0-or-later", ("gpl-redistribute-3",)),
    ("GPL-2.0-or-later", ("gpl-free", "gpl-redistribute-2", "gpl-warranty")),
    ("GPL-2.0-or-later", ("gpl-redistribute-2",)),
    ("GPL-3.0-only", ("gpl3-notice",)),
    ("CC-BY-NC-4.0", ("ccbync4-notice",)),
    ("CC-BY-SA-4.0", ("ccbysa4-notice",)),
    ("CC-BY-4.0", ("ccby4-notice",)),
    ("MPL-2.0", ("mpl2-notice",)),
    ("CC0-1.0", ("cc0-notice",)),
)
#: Sentences of other text allowed between two sentences of a rule.
GAP = 2
#: A sentence ends at a line break, or at . ! ? ; : before white space or the end; comment marks may begin a line.
SENTENCE = re.compile(r"[^\n]+?(?:[.!?;:]+(?=\s|$)|(?=\n)|$)")


def normalised(sentence: str) -> str:
    """Letters and digits in lower case, single spaces."""
    return " ".join(re.findall(r"[^\W_]+", sentence.lower()))


KNOWN = {normalised(s): name for name, wordings in SENTENCES.items() for s in wordings}
_LONGEST = max(len(k) for k in KNOWN)


def _telling(sentences: list[str]) -> list[str]:
    """A few single words of which each sentence has one: the word in most of the sentences left, the longest of those."""
    left, out = [set(s.split()) for s in sentences], []
    while left:
        words = sorted({w for s in left for w in s if len(w) >= min(6, max(map(len, s)))})
        out.append(max(words, key=lambda w: (sum(w in s for s in left), len(w))))
        left = [s for s in left if out[-1] not in s]
    return out


#: A text without any of these words holds no known sentence, however its lines are broken.
HINT = "(?iu)" + "|".join(_telling(sorted(KNOWN)))


def sentences(text: str) -> list[tuple[int, int, str]]:
    """Start, end (code points) and normalised form of each sentence with a letter or digit.

    A sentence that goes on over line breaks is also offered joined with the lines after it, as long as it can be a
    known one.
    """
    return [(m.start(), m.end(), n) for m in SENTENCE.finditer(text) if (n := normalised(m[0]))]


def identified(text: str) -> list[tuple[str, int, int, int, int]]:
    """(identifier, start, end, first and last sentence number) of the known sentences of a text, longest first.

    A known sentence may be spread over several cut sentences (wrapped lines, semicolons within).
    """
    cuts, out, i = sentences(text), [], 0
    while i < len(cuts):
        joined, best = "", None
        for j in range(i, len(cuts)):
            joined = f"{joined} {cuts[j][2]}" if joined else cuts[j][2]
            if len(joined) > _LONGEST:
                break
            if joined in KNOWN:
                best = j, KNOWN[joined]
        if best:
            out.append((best[1], cuts[i][0], cuts[best[0]][1], i, best[0]))
            i = best[0] + 1
        else:
            i += 1
    return out


def matched(found: list[tuple[str, int, int, int, int]]) -> list[tuple[str, int, int]]:
    """(licence, start, end) of the rules that an identifier sequence satisfies, in text order; each sentence counts once."""
    free, out = set(range(len(found))), []
    for licence, rule in sorted(RULES, key=lambda r: -len(r[1])):
        for first in range(len(found)):
            at, places = first, []
            for name in rule:
                while at < len(found) and (at not in free or found[at][0] != name):
                    if not places or found[at][3] - found[places[-1]][4] > GAP:
                        break
                    at += 1
                if at >= len(found) or at not in free or found[at][0] != name:
                    break
                if places and found[at][3] - found[places[-1]][4] - 1 > GAP:
                    break
                places.append(at)
                at += 1
            if len(places) == len(rule):
                free -= set(places)
                out.append((licence, found[places[0]][1], found[places[-1]][2]))
    return sorted(out, key=lambda x: (x[1], x[2], x[0]))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``sentence_ids`` (in order) and ``licences`` (array of struct(licence, start, end) in text order).

    The text is dropped.  Spans are code points, end exclusive.  A null or empty text has none.  Rows and other
    columns stay; columns of these names are replaced.
    """
    kind = "array<struct<licence:string,start:int,end:int>>"
    rest = without(docs, text, "sentence_ids", "licences")
    rest = rest.withColumn(text, F.when(text_of(text).rlike(HINT), F.col(text)))  # other texts need not reach Python
    at = rest.columns.index(text)
    shape = pa.list_(pa.struct([("licence", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, licences = [], []
            for value in batch.column(at):
                found = identified(value.as_py() or "")
                ids.append([f[0] for f in found])
                licences.append([dict(zip(("licence", "start", "end"), m)) for m in matched(found)])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(ids, pa.list_(pa.string())), pa.array(licences, shape)],
                names=[*batch.schema.names, "sentence_ids", "licences"],
            )

    schema = rest.withColumn("sentence_ids", F.lit(None).cast("array<string>")).withColumn("licences", F.lit(None).cast(kind)).schema
    return rest.mapInArrow(run, schema).drop(text)
