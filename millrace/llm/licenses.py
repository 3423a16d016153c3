"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GOLDEN, flat, lists, mix, shingles, spans, tune, word_hashes

CONTAINED = 0.8

#: Notices and texts of public licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "GPL-2.0 header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "licensed under the GNU General Public License, version 3",
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-3.0": "licensed under the GNU Lesser General Public License, version 3",
    "MIT": "Released under the MIT License",
    "MIT text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
}


#: Windows of 1, 2, 4, 8 or 16 shingles, and the distance of the text's windows of each size. A template of n shingles is met by
#: windows of the largest size that is no larger than n; the template's own windows begin at each of its shingles.
#: What guarantees a meeting: at least four fifths of the template's shingles stand in the text, in their order. Of one to four that
#: is all of them, so that a window of the text equals one of the template. Of 5 to 7, one is missing at most: a window of 4 keeps 3
#: and has a similarity of 3/5 or more. Of 8 to 15, three are missing at most, one of two disjoint windows keeps 6 of 8, and the text's
#: windows lie one place beside it at most: 5/11. Of 16 or more, windows every 4 places keep 10 of 16 on the worst template (16 long): 10/22.
#: BANDS bands of one row miss a similarity of 5/11 with a probability of (6/11) ** 28 = 4e-8, each time a template occurs.
STRIDES = {1: 1, 2: 1, 4: 1, 8: 2, 16: 4}
BANDS = 28


def _seeds(size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, (1 if size == 1 else BANDS) + 1, dtype=np.uint64) * GOLDEN + np.uint64(size))


def _lowest(h: np.ndarray, seed: np.uint64, size: int) -> np.ndarray:
    """One row of MinHash for every window of ``size`` shingles."""
    with np.errstate(over="ignore"):
        x = (h ^ seed) * np.uint64(0xD6E8FEB86659FD93)
    have = 1
    while have < size:  # sizes are powers of two
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return x


class Index:
    """Templates by the MinHash values of their windows. Its size is that of the templates: a few KB each, checked below."""

    MOST = 64_000_000

    def __init__(self, templates: dict[str, np.ndarray]):
        self.names = sorted(templates)
        self.sets = [np.unique(templates[n]) for n in self.names]
        self.bands: list[tuple[int, np.uint64, np.ndarray, np.ndarray, np.ndarray]] = []
        for size in STRIDES:
            mine = [i for i, n in enumerate(self.names) if size <= len(templates[n]) and (size == max(STRIDES) or len(templates[n]) < 2 * size)]
            for seed in _seeds(size) if mine else ():
                rows = [np.unique(_lowest(templates[self.names[i]], seed, size)) for i in mine]
                values = np.concatenate(rows)
                order = np.argsort(values, kind="stable")
                sieve = np.zeros(1 << 16, bool)
                sieve[values >> np.uint64(48)] = True
                self.bands.append((size, seed, values[order], np.repeat(mine, [len(r) for r in rows])[order], sieve))
        nbytes = sum(v.nbytes + o.nbytes + s.nbytes for _, _, v, o, s in self.bands) + sum(s.nbytes for s in self.sets)
        if nbytes > self.MOST:
            raise ValueError(f"the templates make an index of {nbytes} bytes; scan with at most {self.MOST} bytes at a time")

    def candidates(self, h: np.ndarray, row: np.ndarray) -> list[tuple[int, int]]:
        """(row, template) pairs of which a window collides in some band. h: the rows' shingles, one row after another."""
        met = [np.zeros((0, 2), np.int64)]
        for size, seed, values, which, sieve in self.bands:
            if len(h) < size:
                continue
            at = np.arange(0, len(h) - size + 1, STRIDES[size])
            low = _lowest(h, seed, size)[at]
            maybe = np.flatnonzero(sieve[low >> np.uint64(48)])
            begin, end = (np.searchsorted(values, low[maybe], side) for side in ("left", "right"))
            n = end - begin
            if not n.any():
                continue
            entry = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            # a window may run into the next row: both are candidates then, and are verified
            for near in (row[at[maybe]], row[at[maybe] + size - 1]):
                met.append(np.unique(np.stack([np.repeat(near, n), which[entry]], axis=1), axis=0))
        return [tuple(x) for x in np.unique(np.concatenate(met), axis=0).tolist()]


def index(spark: SparkSession, templates: dict[str, str]) -> Index:
    """Shingle the templates as documents are; their number is up to the caller and small."""
    rows = spark.createDataFrame([(n, t) for n, t in templates.items()], "name string, text string").select("name", word_hashes(F.col("text")).alias("w")).collect()
    made = {}
    for r in rows:
        w = np.array(r["w"], np.int64)
        made[r["name"]] = shingles(w, np.array([0, len(w)]))[0]
    return Index(made)


def licenses(docs: DataFrame, text: str = "text", templates: dict[str, str] | None = None, contained: float = CONTAINED, into: str = "_licenses") -> DataFrame:
    """All columns of ``docs`` and ``into``: an array of (license, containment) for each template found in the text.

    A template counts when a window of the text meets one of the template in a band, and at least ``contained`` of the
    template's distinct five-word shingles occur in the text. A template of which four fifths stand together is missed
    with a probability of at most 4e-8 (above). Null, empty and wordless texts have none; a template of fewer than five
    words is one shingle, as is a text of fewer than five. Texts of any length are scanned whole.
    """
    spark = docs.sparkSession
    tune(spark)
    sent = spark.sparkContext.broadcast(index(spark, TEMPLATES if templates is None else templates))

    @F.arrow_udf("array<struct<license:string,containment:double>>")
    def scan(column: pa.Array) -> pa.Array:
        known: Index = sent.value
        values, offsets = lists(column)
        out: list[list[dict]] = [[] for _ in range(len(column))]
        for begin, end in spans(offsets, 200_000):
            cut = offsets[begin : end + 1]
            h, row = shingles(values[cut[0] : cut[-1]], cut - cut[0])
            ends = np.searchsorted(row, np.arange(end - begin + 1))
            for r, i in known.candidates(h, row):
                share = float(np.isin(known.sets[i], h[ends[r] : ends[r + 1]]).mean())
                if share >= contained:
                    out[begin + r].append({"license": known.names[i], "containment": share})
        return pa.array(out, pa.list_(pa.struct([("license", pa.string()), ("containment", pa.float64())])))

    rows, at = flat(docs)
    rows = rows.withColumn("_found", scan(word_hashes(F.col(at[text]))))
    return rows.toDF(*docs.columns, into)
