"""License scans over a positional rare-token index.

The licence templates' words are indexed with their positions.  Each template's rarest words
(by document frequency over the whole corpus) are looked up in a file; file and template
positions give a place, whose share of matching words is the score.  So many words of each
template are looked up that a place with the least share must hold one of them.  A template counts only where its mandatory key phrase stands.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from briefloom.llm.common import table
from briefloom.llm.texts import map_texts

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
#: Phrases that always give their label.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Fixed values: (label, template words, mandatory key phrase).
TEMPLATES = (
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "permission is hereby granted free of charge"),
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache license"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", "affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice", "with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions of source code must retain"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "redistributions in binary form must reproduce"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "unless required by applicable law or agreed to in writing"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "copies or substantial portions of the software"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", "eclipse public license"),
    ("boost", "distributed under the boost software license version 1 0", "boost software license"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable"),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license", "common development and distribution license"),
    ("eupl", "licensed under the european union public licence", "european union public licence"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived all copyright and related or neighboring rights"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    ("cc-by-nd", "this work is licensed under a creative commons attribution noderivatives 4 0 international license", "creative commons attribution noderivatives"),
)
#: Whole texts of short licences and whole notices of long ones, (label, words); cut into sentences below.
WHOLE = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions. the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software. the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement. in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies. the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met. redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer. redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution. this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed. in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions. the origin of this software must not be misrepresented you must not claim that you wrote the original software. if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required. altered source versions must be plainly marked as such and must not be misrepresented as being the original software. this notice may not be removed or altered from any source distribution"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means. in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain. we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software. the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or in part"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed. you just do what the fuck you want to"),
    ("0bsd", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted. the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("apache", "you may obtain a copy of the license at http www apache org licenses license 2 0. see the license for the specific language governing permissions and limitations under the license. terms and conditions for use reproduction and distribution. each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form"),
    ("gpl-2.0", "published by the free software foundation either version 2 of the license or at your option any later version. gnu general public license version 2 june 1991"),
    ("gpl-3.0", "published by the free software foundation either version 3 of the license or at your option any later version. gnu general public license version 3 29 june 2007"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose. you should have received a copy of the gnu general public license along with this program"),
    ("lgpl", "you should have received a copy of the gnu lesser general public license along with this library. gnu lesser general public license version 2 1 february 1999. gnu lesser general public license version 3 29 june 2007"),
    ("agpl", "you should have received a copy of the gnu affero general public license along with this program. gnu affero general public license version 3 19 november 2007"),
    ("mpl", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("epl", "which accompanies this distribution and is available at https www eclipse org legal epl"),
    ("artistic", "you may modify it under the terms of the artistic license. the intent is that this license which establishes the terms under which the package may be copied modified and distributed"),
    ("ofl", "this font software is licensed under the sil open font license version 1 1. the goals of the open font license ofl are to stimulate worldwide development of collaborative font projects"),
    ("ms-pl", "this license governs use of the accompanying software if you use the software you accept this license if you do not accept the license do not use the software"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"),
    ("cc-by", "to view a copy of this license visit http creativecommons org licenses by 4 0"),
    ("cc-by-sa", "to view a copy of this license visit http creativecommons org licenses by sa 4 0"),
    ("cc-by-nc", "to view a copy of this license visit http creativecommons org licenses by nc 4 0"),
)
#: Identifiers that stand behind "SPDX-License-Identifier:", in words, and their labels.
SPDX = {
    "mit": "mit", "apache 2 0": "apache", "bsd 2 clause": "bsd", "bsd 3 clause": "bsd-3-clause", "isc": "isc", "gpl 2 0": "gpl-2.0", "gpl 3 0": "gpl-3.0", "lgpl 2 1": "lgpl", "lgpl 3 0": "lgpl",
    "agpl 3 0": "agpl", "mpl 2 0": "mpl", "epl 2 0": "epl", "bsl 1 0": "boost", "zlib": "zlib", "unlicense": "unlicense", "cc0 1 0": "cc0", "cc by 4 0": "cc-by", "cc by sa 4 0": "cc-by-sa",
    "cc by nc 4 0": "cc-by-nc", "ofl 1 1": "ofl", "wtfpl": "wtfpl", "0bsd": "0bsd", "artistic 2 0": "artistic", "ms pl": "ms-pl", "cddl 1 0": "cddl", "eupl 1 2": "eupl",
}


def sentences(key: int = 5) -> tuple:
    """Templates of the whole texts' sentences, and of SPDX lines.

    A sentence's key phrase are ``key`` words, as near its middle as may be, that no other licence's
    texts hold; a sentence without such words tells no licences apart and is left out.
    """
    runs = lambda words: [" ".join(words[i : i + key]) for i in range(max(1, len(words) - key + 1))]
    parts = [(label, part.split()) for label, text in WHOLE for part in text.split(". ")]
    others: dict[str, set[str]] = {}
    for label, words in parts + [(label, text.split()) for label, text, _ in TEMPLATES]:
        for run in runs(words):
            others.setdefault(run, set()).add(label)
    out = []
    for label, words in parts:
        own = sorted((abs(2 * i - len(words) + key), i, run) for i, run in enumerate(runs(words)) if others[run] == {label})
        if own:
            out.append((label, " ".join(words), own[0][2]))
    return tuple(dict.fromkeys(out + [(label, line, line) for name, label in SPDX.items() for line in (f"spdx license identifier {name}",)]))


ALL_TEMPLATES = tuple(dict.fromkeys(TEMPLATES + sentences()))
#: Rarest words of a template that are looked up at least, and the share of it that must match.
RARE_WORDS, LEAST_SHARE = 8, 0.75

NEW = {
    "n_words": "long", "n_base": "long", "first_word": "long", "last_word": "long", "base_labels": "string", "labels": "string", "score": "double",
}


def words_of(text: str | None) -> list[str]:
    """Words after lower-casing A-Z only."""
    if not text:
        return []
    low = text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    return WORD.findall(low)


class Index:
    """Postings of the templates' words: word -> [(template, position)]."""

    def __init__(self, templates=ALL_TEMPLATES):
        self.labels = [t[0] for t in templates]
        self.texts = [t[1].split() for t in templates]
        self.keys = [t[2].split() for t in templates]
        self.postings: dict[str, list[tuple[int, int]]] = {}
        for k, text in enumerate(self.texts):
            for p, w in enumerate(text):
                self.postings.setdefault(w, []).append((k, p))
        self.phrases = {tuple(p.split()): label for p, label in BASE.items()}
        self.words = frozenset(self.postings) | {w for p in self.phrases for w in p} | {w for k in self.keys for w in k}

    def base(self, where: dict[str, list[int]], words: list[str]) -> list[tuple[int, str]]:
        """Places of the base phrases: (word number, label)."""
        found = []
        for phrase, label in self.phrases.items():
            n = len(phrase)
            found += [(p, label) for p in where.get(phrase[0], ()) if tuple(words[p : p + n]) == phrase]
        return sorted(found)

    def rarest(self, idf: dict[str, float]) -> list[list[str]]:
        """Each template's words to look up: the rarest ones, on more positions than may differ at a place."""
        out = []
        for text in self.texts:
            may_differ = len(text) - math.ceil(LEAST_SHARE * len(text))
            picked, covered, count = [], 0, Counter(text)
            for w in sorted(count, key=lambda w: (-idf.get(w, math.inf), w)):
                if len(picked) >= RARE_WORDS and covered > may_differ:
                    break
                picked.append(w)
                covered += count[w]
            out.append(picked)
        return out

    def match(self, where: dict[str, list[int]], words: list[str], rarest: list[list[str]]) -> tuple[set[str], float]:
        """Labels of the templates found, and the best share of a template that matches."""
        able = {k for k, key in enumerate(self.keys) if all(w in where for w in key)}
        if not able:
            return set(), 0.0
        places = dict.fromkeys((k, p - q) for k in sorted(able) for w in rarest[k] for j, q in self.postings[w] if j == k for p in where.get(w, ()))
        labels, best = set(), 0.0
        for k, at in places:
            text, key = self.texts[k], self.keys[k]
            share = sum(words[at + i] == w for i, w in enumerate(text) if 0 <= at + i < len(words)) / len(text)
            if share <= best and self.labels[k] in labels or share < LEAST_SHARE:
                continue
            near = words[max(0, at) : at + len(text) + 1]
            if any(near[i : i + len(key)] == key for i in range(len(near))):
                labels.add(self.labels[k])
                best = max(best, share)
        return labels, best


def where_of(words: list[str], among: frozenset[str]) -> dict[str, list[int]]:
    where: dict[str, list[int]] = {}
    for p, w in enumerate(words):
        if w in among:
            where.setdefault(w, []).append(p)
    return where


def licence_word_idf(docs: DataFrame, index: Index) -> dict[str, float]:
    """Inverse document frequency over all documents of the templates' words (at most that many rows)."""
    among = index.words

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, n = Counter(), 0
        for pdf in batches:
            for text in pdf["text"]:
                seen.update(among.intersection(words_of(text)))
                n += 1
        yield pd.DataFrame({"word": [*seen, ""], "n": [*seen.values(), n]})

    counts = docs.select(F.col("text").cast("string").alias("text")).mapInPandas(count, "word string, n long")
    n = {r.word: r.n for r in counts.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    total = n.pop("", 0)
    return {w: math.log((1 + total) / (1 + c)) for w, c in n.items()}


def scan_licenses(docs: DataFrame, templates=ALL_TEMPLATES) -> DataFrame:
    """Find licences in every whole text.

    Returns per input row ``doc_id``, ``n_words``, ``n_base`` (places of the base phrases),
    ``first_word`` and ``last_word`` (smallest and largest start of one, else null),
    ``base_labels``, ``labels`` (the templates' too; both sorted, comma-joined) and ``score``
    (best share of a template that matches; 0.5 for a base phrase alone; else 0).

    Defined cases: a null or empty text has no words, empty labels and score 0; null and
    repeated doc_ids are carried; an empty table gives no rows; further columns are ignored.
    """
    index = Index(templates)
    rarest = index.rarest(licence_word_idf(docs, index))

    def make():
        def one(text):
            words = words_of(text)
            where = where_of(words, index.words)
            base = index.base(where, words)
            labels, score = index.match(where, words, rarest)
            own = {label for _, label in base}
            first, last = (base[0][0], base[-1][0]) if base else (None, None)
            return len(words), len(base), first, last, ",".join(sorted(own)), ",".join(sorted(own | labels)), max(score, 0.5 if base else 0.0)

        return lambda texts: dict(zip(NEW, zip(*map(one, texts)))) if texts else {k: [] for k in NEW}

    return map_texts(docs, make, NEW)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
