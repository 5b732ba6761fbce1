"""Licence scan in DataFrame functions alone.

A text is looked at as a whole, by paragraph and by line. Each such part is normalised (A-Z
lower-cased, words of ASCII letters and digits) and compared to licence templates by the Dice
coefficient of the sets of word bigrams: 2 * common / (part's + template's). A coefficient of
at least ALIKE bounds the size of the part's set on both sides; only templates within these
bounds, and only parts that have a bigram of some template, are compared. Templates are
literals of the query: nothing is broadcast or shuffled.

Null, empty and one-word texts have no bigram and no match. Repeated rows are scanned each;
only doc_id and text are read. Equal coefficients go to the licence whose name is first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALIKE = 0.7

#: Short notices and grants of public licences.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0', 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "MIT": ["Released under the MIT License.", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:', "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}

UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def plain_words(text: str) -> list[str]:
    """The words of a template, as the columns have them."""
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c if ("a" <= c <= "z" or "0" <= c <= "9") else " " for c in text).split()


def plain_bigrams(text: str) -> list[str]:
    w = plain_words(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})


def bigrams(text: Column) -> Column:
    """The distinct word bigrams of a normalised part."""
    words = F.filter(F.split(F.translate(text, UPPER, SMALL), "[^a-z0-9]+"), lambda w: w != "")
    pairs = lambda w: F.when(F.size(w) > 1, F.array_distinct(F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b)))).otherwise(F.array().cast("array<string>"))
    return F.element_at(F.transform(F.array(words), pairs), 1)


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, alike: float = ALIKE) -> DataFrame:
    """doc_id, licence (the best match's name, or null), dice (its coefficient, or null), n_parts (parts that match any template) of every row."""
    known = [(name, b) for name, texts in sorted((templates or TEMPLATES).items()) for t in texts if (b := plain_bigrams(t))]
    known.sort(key=lambda x: x[0])
    all_bigrams = sorted({g for _, b in known for g in b})
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    parts = F.array_distinct(F.concat(F.array(text), F.split(text, r"\n[ \t]*\n"), F.split(text, r"\n")))

    def best(part: Column) -> Column:
        """(coefficient, licence) of the best template of a part, or null."""

        def against(both: Column) -> Column:
            size, own = both["size"].cast("long"), both["own"]
            found = []
            for i, (name, b) in enumerate(known):
                low, high = alike / (2 - alike) * len(b), (2 - alike) / alike * len(b)
                common = F.size(F.array_intersect(own, F.array(*map(F.lit, b))))
                found.append(F.when(size.between(F.lit(low), F.lit(high)), F.struct((2 * common / (size + len(b))).alias("dice"), F.lit(-i).alias("rank"), F.lit(name).alias("licence"))))
            return F.array_max(F.filter(F.array(*found), lambda x: x["dice"] >= alike))

        shared = F.element_at(F.transform(F.array(bigrams(part)), lambda b: F.struct(F.size(b).alias("size"), F.filter(b, lambda g: g.isin(all_bigrams)).alias("own"))), 1)
        return F.element_at(F.transform(F.array(shared), lambda x: F.when(F.size(x["own"]) > 0, against(x))), 1)

    rows = docs.select("doc_id", F.filter(F.transform(parts, best), lambda x: x.isNotNull()).alias("found"))
    top = F.array_max("found")
    return rows.select("doc_id", top["licence"].alias("licence"), top["dice"].alias("dice"), F.size("found").cast("long").alias("n_parts"))


def oracle(templates: dict[str, list[str]] | None = None, alike: float = ALIKE) -> str:
    """The same in DuckDB's SQL."""
    known = [(name, b) for name, texts in sorted((templates or TEMPLATES).items()) for t in texts if (b := plain_bigrams(t))]
    known.sort(key=lambda x: x[0])
    rows = ", ".join(f"({i}, '{name}', [{', '.join(repr(g) for g in b)}])" for i, (name, b) in enumerate(known))
    return f"""
WITH templates(rank, licence, grams) AS (VALUES {rows}),
docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
parts AS (SELECT DISTINCT row, unnest(list_concat([text], list_concat(regexp_split_to_array(text, '\\n[ \\t]*\\n'), string_split(text, chr(10))))) AS part FROM docs),
words AS (SELECT row, part, list_filter(regexp_split_to_array(translate(part, '{UPPER}', '{SMALL}'), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM parts),
grams AS (SELECT row, part, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM words WHERE len(w) > 1),
near AS (SELECT row, part, rank, licence, 2 * len(list_intersect(b, grams)) / (len(b) + len(grams)) AS dice FROM grams, templates WHERE list_has_any(b, grams)),
best AS (SELECT row, part, max(dice) AS dice, arg_max(licence, struct_pack(dice := dice, rank := -rank)) AS licence, arg_max(-rank, struct_pack(dice := dice, rank := -rank)) AS rank FROM near WHERE dice >= {alike} GROUP BY row, part),
by_row AS (SELECT row, max(dice) AS dice, arg_max(licence, struct_pack(dice := dice, rank := rank)) AS licence, count(*) AS n_parts FROM best GROUP BY row)
SELECT doc_id, licence, dice, coalesce(n_parts, 0) AS n_parts FROM docs LEFT JOIN by_row USING (row)"""
