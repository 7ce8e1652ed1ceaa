"""License scans: MinHash bands over overlapping windows retrieve notices, exact shingle containment verifies them.

Built from DataFrame functions alone.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Notices and texts as their licences or customary use give them: licence, text, and the words of it that tell
#: it from its siblings, which must stand whole where it is found.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", "license version 2 0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at", ""),
    ("MIT", "Released under the MIT License.", ""),
    ("MIT", "This project is licensed under the MIT License.", ""),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ""),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
     "Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
     "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
     "conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE "
     "SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
     "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
     "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
     "DEALINGS IN THE SOFTWARE.", ""),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
     "above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH "
     "REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
     "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
     "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.", ""),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2.", "gnu general public license version 2"),
    ("GPL-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", "gnu general public license as / either version 2 of"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", "gnu general public license version 3"),
    ("GPL-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "gnu general public license as / either version 3 of"),
    ("LGPL-2.1", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License", "gnu lesser general public license / either version 2 1 of"),
    ("LGPL-3.0", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License", "gnu lesser general public license / either version 3 of"),
    ("AGPL-3.0", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License", "gnu affero general public license / either version 3 of"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ""),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", ""),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "public license v 2 0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", "cc by nc 4 0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "creative commons attribution 4 0 international"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "creative commons attribution sharealike 4 0 international"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "creative commons attribution noncommercial 4 0 international"),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "creative commons attribution noderivatives 4 0 international"),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "creative commons attribution noncommercial sharealike 4 0 international"),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "creative commons attribution noncommercial noderivatives 4 0 international"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights", ""),
    ("Unlicense", "This is free and unencumbered software released into the public domain.", ""),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0.", "license version 1 0"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
     "met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. "
     "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
     "documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "
     "AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
     "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
     "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, "
     "DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
     "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.", ""),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
     "met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. "
     "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
     "documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its "
     "contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS "
     "SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
     "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
     "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
     "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
     "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
     "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.", "neither the name of"),
    ("Zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages "
     "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
     "applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not "
     "be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in "
     "the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must "
     "not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.", ""),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
     "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any "
     "means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in "
     "the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and "
     "successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software "
     "under copyright law.", ""),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
     "documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to "
     "prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the "
     "following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the "
     "following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, "
     "unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.", ""),
    ("MIT", "The MIT License (MIT)", ""),
    ("GPL-2.0", "GNU General Public License version 2 as published by the Free Software Foundation", "gnu general public license version 2 as"),
    ("GPL-3.0", "GNU General Public License version 3 as published by the Free Software Foundation", "gnu general public license version 3 as"),
    ("GPL-2.0", "Licensed under the GNU General Public License v2.0", "gnu general public license v2 0"),
    ("GPL-3.0", "Licensed under the GNU General Public License v3.0", "gnu general public license v3 0"),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License v2.1", "gnu lesser general public license v2 1"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License v3.0", "gnu lesser general public license v3 0"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License v3.0", "gnu affero general public license v3 0"),
    ("LGPL-2.0", "under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License", "gnu library general public license / either version 2 of"),
    ("CC-BY-3.0", "This work is licensed under a Creative Commons Attribution 3.0 Unported License.", "creative commons attribution 3 0 unported"),
    ("CC-BY-SA-3.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.", "creative commons attribution sharealike 3 0 unported"),
    ("CC-BY-NC-3.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 3.0 Unported License.", "creative commons attribution noncommercial 3 0 unported"),
    ("CC-BY-ND-3.0", "This work is licensed under a Creative Commons Attribution-NoDerivs 3.0 Unported License.", "creative commons attribution noderivs 3 0 unported"),
    ("CC-BY-NC-SA-3.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 3.0 Unported License.", "creative commons attribution noncommercial sharealike 3 0 unported"),
    ("CC-BY-NC-ND-3.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivs 3.0 Unported License.", "creative commons attribution noncommercial noderivs 3 0 unported"),
]
#: Licences that source files name by a line of their own.
SPDX = ("Apache-2.0", "MIT", "ISC", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "Unlicense", "BSL-1.0", "Zlib")
NOTICES += [(name, f"SPDX-License-Identifier: {name}", f"license identifier {name.lower().replace('-', ' ').replace('.', ' ')}") for name in SPDX]
#: Licences whose conditions hold another one's: where the first is found, the second isn't reported within NEAR words.
COVERS = {"BSD-3-Clause": "BSD-2-Clause"}
NEAR = 150

SHINGLE = 3  #: words
PIECE = 5  #: words of a notice that are looked for as one
WINDOW = 9  #: words; with a step of WINDOW - PIECE + 1 every piece lies whole in some window
STEP = WINDOW - PIECE + 1
BANDS = 16  #: of one row; a piece's 3 shingles among a window's 7 meet in one with 1 - (4/7)**16 = 0.9998
_SPAN = WINDOW - SHINGLE + 1


def _seeds() -> list[int]:
    """Of all 64 bits: a seed without the sign's bit would leave every negative hash before all others in each band."""
    rng = random.Random(7)
    return [rng.getrandbits(64) - (1 << 63) for _ in range(BANDS)]


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def _shingles(text: Column) -> Column:
    """Hashes of all runs of SHINGLE words, in text order. The words are bound to a variable, so they are split once."""

    def hashed(words: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(words) - SHINGLE)
        some = F.transform(at, lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(SHINGLE))))
        return F.when(F.size(words) >= SHINGLE, some).otherwise(F.array().cast("array<bigint>"))

    return F.get(F.transform(F.array(_words(text)), hashed), F.lit(0))


def _marks(shingles: Column, start: Column, found: list[int]) -> Column:
    """The shingles that stand in the window's bands and in some notice.

    A band holds the least shingle under its own order, which compares hashes after an exclusive or with its seed.
    """
    seeds = F.array(*map(F.lit, _seeds()))

    def bands(window: Column) -> Column:
        return F.transform(seeds, lambda seed: F.array_min(F.transform(window, lambda x: x.bitwiseXOR(seed))).bitwiseXOR(seed))

    bound = F.get(F.transform(F.array(F.slice(shingles, start + 1, _SPAN)), bands), F.lit(0))
    return F.array_distinct(F.filter(bound, lambda x: x.isin(found)))


def notices(spark: SparkSession, rows: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """(template, license_id, text, must) as a local relation."""
    quoted = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    listed = ", ".join(f"({i}, {quoted(a)}, {quoted(b)}, {quoted(c)})" for i, (a, b, c) in enumerate(rows or NOTICES))
    return spark.sql(f"SELECT * FROM VALUES {listed} AS t(template, license_id, text, must)")


def license_scan(docs: DataFrame, templates: list[tuple[str, str, str]] | None = None, containment: float = 0.8) -> DataFrame:
    """One row for each document and licence found: doc_id, license_id, containment.

    Words are runs of a-z and 0-9 in lower case. containment is the share of a notice's distinct shingles that occur
    around a retrieved window, at most the notice's length away; the best of a licence's notices counts if it
    reaches the threshold. The words that tell a notice from its siblings (its version, Lesser, ShareAlike) must all be
    there: `must` has them, phrases of three words or more, parted by slashes. Where a licence is found that COVERS
    another one, the other isn't reported within NEAR words, but elsewhere in the document it is. `templates` are (licence, notice, must), a parameter of a few
    hundred at most; notices under three words are never found. Null and empty texts give no rows; repeated ids count as
    one document; null ids are kept; extra columns are ignored. A text's shingles are an array of a row, however long it is,
    and windows are exploded from it one by one.
    """
    spark = docs.sparkSession
    known = notices(spark, templates).withColumn("shingles", _shingles(F.col("text"))).where(F.size("shingles") > 0)
    known = known.withColumn("must", F.array_distinct(F.flatten(F.transform(F.split("must", "/"), _shingles))))
    pieces = known.select("template", F.posexplode("shingles").alias("at", "first"), "shingles").where((F.col("at") % STEP == 0) | (F.col("at") == F.size("shingles") - 1))
    own = [F.get("shingles", F.col("at") + k) for k in range(PIECE - SHINGLE + 1)]
    # a band of a notice's piece may hold any of its shingles, whichever is least beside the window's others
    marks = pieces.select("template", F.explode(F.array_compact(F.array(*own))).alias("shingle")).distinct()
    rows = marks.collect()  # a few for each notice
    found = sorted({r.shingle for r in rows})

    words = docs.select("doc_id", _shingles(F.coalesce("text", F.lit(""))).alias("shingles"))
    starts = F.when(F.size("shingles") > 0, F.sequence(F.lit(0), F.size("shingles") - 1, F.lit(STEP)))
    windows = F.filter(F.transform(starts, lambda i: F.struct(i.alias("start"), _marks(F.col("shingles"), i, found).alias("marks"))), lambda w: F.size(w["marks"]) > 0)
    # an inner explode would have its condition, and so all below it, worked out a second time
    met = words.select("doc_id", "shingles", F.explode_outer(windows).alias("w")).where(F.col("w").isNotNull())
    met = met.select("doc_id", "shingles", F.col("w.start").alias("start"), F.explode("w.marks").alias("shingle"))
    listed = spark.sql("SELECT * FROM VALUES " + ", ".join(f"({r.template}, {r.shingle}L)" for r in rows) + " AS t(template, shingle)") if rows else marks
    retrieved = met.join(F.broadcast(listed), "shingle").join(F.broadcast(known.select("template", "license_id", F.array_distinct("shingles").alias("wanted"), "must")), "template")
    low = F.greatest(F.lit(0), F.col("start") - F.size("wanted"))
    around = F.slice("shingles", low + 1, F.col("start") + _SPAN + F.size("wanted") - low)
    # bound to a variable, so that the slice is worked out once
    score = F.get(F.transform(F.array(around), lambda x: F.when(F.size(F.array_except("must", x)) == 0, F.size(F.array_intersect("wanted", x)) / F.size("wanted"))), F.lit(0))
    scored = retrieved.select("doc_id", "license_id", "start", score.alias("containment"))
    placed = scored.where(F.col("containment") >= containment).groupBy("doc_id", "license_id", "start").agg(F.max("containment").alias("containment"))
    around = Window.partitionBy("doc_id").orderBy("start").rangeBetween(-NEAR, NEAR)  # the hits of a document
    for first, second in COVERS.items():
        covered = F.count(F.when(F.col("license_id") == first, 1)).over(around) > 0
        placed = placed.withColumn("covered", covered).where(~F.col("covered") | (F.col("license_id") != second)).drop("covered")
    return placed.groupBy("doc_id", "license_id").agg(F.max("containment").alias("containment"))
