"""License scans: lines and paragraphs compared with notice templates by Dice's coefficient over word bigrams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import SPACES

#: Notices by licence, as their stewards recommend them.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("Proprietary", "All rights reserved."),
)


def template_bigrams(text: str) -> list[str]:
    """Distinct bigrams of the lower-cased words of letters and digits; one word is a gram of its own."""
    words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])} or {*words})


def scan_licenses(docs: DataFrame, threshold: float = 0.8, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """For every row of docs: doc_id, n_units long (lines and paragraphs with words enough to match), n_matches long, license string (of the best match, null: none), dice double (0: none) and licenses string (all found, sorted, joined by commas).

    docs: doc_id and text; other columns are ignored. Units are a text's lines
    and, where several lines stand between blank ones, the paragraph. A unit
    with s bigrams can reach the threshold t only with templates of t/(2-t) to
    (2-t)/t times s bigrams; others are not compared. Ties go to the licence
    that sorts first. Null, empty and blank texts match nothing; repeated rows
    give repeated rows; very long texts are scanned whole; an empty table gives
    no rows. No row leaves its task: there is nothing to shuffle.
    The templates are constants, so their size is bounded.
    """
    kinds = T.StructType([T.StructField("id", T.StringType()), T.StructField("grams", T.ArrayType(T.StringType()))])
    grams = [(i, template_bigrams(t)) for i, t in templates]
    sizes = [len(g) for _, g in grams]
    # a little wider than exact, so that rounding loses no pair on the edge
    factor = threshold / (2 - threshold) * (1 - 1e-9)
    low, high = min(sizes) * factor, max(sizes) / factor
    known = F.array(*[F.struct(F.lit(i).alias("id"), F.array(*map(F.lit, g)).alias("grams")) for i, g in grams]).cast(T.ArrayType(kinds))
    every = F.array(*map(F.lit, sorted({x for _, g in grams for x in g})))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    blocks = F.filter(F.split(text, r"\n[\x20\x09-\x0D]*\n", -1), lambda x: F.contains(x, F.lit("\n")))
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.concat(F.split(text, "\n", -1), blocks).alias("units"))
    # n bigrams need 2 n + 1 characters at least
    least = 2 * max(1, int(low)) + 1
    words = lambda u: F.split(F.btrim(F.regexp_replace(F.lower(u), r"[^\p{L}\p{N}]+", " "), F.lit(SPACES)), " ", -1)
    df = df.select("doc_id", F.transform(F.filter("units", lambda u: F.char_length(u) >= least), words).alias("units"))
    df = df.select("doc_id", F.filter("units", lambda w: F.size(w) - 1 >= low).alias("units"))
    pairs = F.expr("transform(units, w -> array_distinct(transform(sequence(0, size(w) - 2), i -> concat(get(w, i), ' ', get(w, i + 1)))))")
    df = df.select("doc_id", F.filter(pairs, lambda g: F.size(g).between(low, high)).alias("units"))
    df = df.select("doc_id", F.size("units").cast("long").alias("n_units"), F.filter("units", lambda g: F.arrays_overlap(g, every)).alias("units"))

    def compared(g):
        fit = F.filter(known, lambda t: (F.size(t["grams"]) >= F.size(g) * factor) & (F.size(t["grams"]) * factor <= F.size(g)))
        return F.transform(fit, lambda t: F.struct((2.0 * F.size(F.array_intersect(g, t["grams"])) / (F.size(g) + F.size(t["grams"]))).alias("dice"), t["id"].alias("id")))

    best = F.transform("units", lambda g: F.array_sort(F.filter(compared(g), lambda s: s["dice"] >= threshold), lambda a, b: F.when(a["dice"] > b["dice"], -1).when(a["dice"] < b["dice"], 1).when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)))
    df = df.select("doc_id", "n_units", F.transform(F.filter(best, lambda s: F.size(s) > 0), lambda s: F.get(s, F.lit(0))).alias("hits"))
    top = F.get(F.array_sort("hits", lambda a, b: F.when(a["dice"] > b["dice"], -1).when(a["dice"] < b["dice"], 1).when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)), F.lit(0))
    return df.select("doc_id", "n_units", F.size("hits").cast("long").alias("n_matches"), top["id"].alias("license"), F.coalesce(top["dice"], F.lit(0.0)).alias("dice"), F.array_join(F.sort_array(F.array_distinct(F.transform("hits", lambda s: s["id"]))), ",").alias("licenses"))
