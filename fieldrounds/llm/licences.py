"""License scans by canonical digest lookup, with Spark expressions only.

A text is put in canonical form: lower case, one spelling of words that licences spell in two ways, copyright lines left out, and
everything but letters and digits a single space. The digest of the whole canonical text is joined to the digests of known
licences; so is the digest of each line, which finds one-line notices inside other texts. The known texts are a fixed
list, so that side of the join is a few rows.

Cases: a null or empty text, or one that has only punctuation or copyright lines, has an empty canonical form, which
matches nothing. Repeated rows are reported alike. A text that is one line and a known notice is reported once, as whole. Only the
id and the text are read.
"""
from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Licence texts and notices as published. More are added by appending to this list.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR
ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH
THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY
DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZERO_BSD = ISC.replace(""" hereby granted, provided that
the above copyright notice and this permission notice appear in all copies.""", " hereby granted.")
BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution.
"""
BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from
this software without specific prior written permission.
"""
BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT
LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON
ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE
USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the
software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and
successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this
software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR
OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE
OR OTHER DEALINGS IN THE SOFTWARE."""
APACHE_HEAD = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions
and limitations under the License."""
MPL_HEAD = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/."""


def _gnu_heads() -> list[tuple[str, str]]:
    """The file headers of the GNU licences, with and without later versions."""
    out = []
    for short, name, versions in (("GPL", "GNU General Public License", ("2", "3")), ("LGPL", "GNU Lesser General Public License", ("2.1", "3")),
                                  ("AGPL", "GNU Affero General Public License", ("3",))):
        for v in versions:
            for grant, later in ((f"either version {v} of the License, or (at your option) any later version", "or-later"), (f"version {v} of the License", "only")):
                out += [(f"{short}-{v if '.' in v else v + '.0'}-{later}", f"""This program is free software: you can redistribute it and/or modify it under the terms of
the {name} as published by the Free Software Foundation, {grant}.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.

You should have received a copy of the {name} along with this program. If not, see <{at}://www.gnu.org/licenses/>.""")
                        for at in ("http", "https")]
    return out


# Whole texts in ``licence_texts``, as published; each file by the licence it is.
WHOLE = {"Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0-Perl", "CC0-1.0": "CC0-1.0", "GPL-1": "GPL-1.0-only", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only",
         "LGPL-2": "LGPL-2.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3": "LGPL-3.0-only", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}


def _whole_texts() -> list[tuple[str, str]]:
    """Each text as published, without what follows its terms, and with either form of its addresses."""
    out = []
    for name, licence in WHOLE.items():
        text = Path(__file__).with_name("licence_texts").joinpath(f"{name}.txt").read_text()
        end = "END OF TERMS AND CONDITIONS"
        for t in [text, *([text[:text.index(end)], text[:text.index(end)] + end] if end in text else [])]:
            out += [(licence, t), (licence, t.replace("https://", "http://")), (licence, t.replace("http://", "https://"))]
    return out


KNOWN = (
    ("MIT", MIT), ("MIT", "MIT License\n\n" + MIT), ("MIT", "The MIT License (MIT)\n\n" + MIT),
    ("ISC", ISC), ("ISC", "ISC License\n\n" + ISC), ("0BSD", ZERO_BSD),
    ("BSD-2-Clause", BSD_HEAD + BSD_TAIL), ("BSD-2-Clause", "BSD 2-Clause License\n\n" + BSD_HEAD + BSD_TAIL),
    ("BSD-3-Clause", BSD_HEAD + BSD_THIRD + BSD_TAIL), ("BSD-3-Clause", "BSD 3-Clause License\n\n" + BSD_HEAD + BSD_THIRD + BSD_TAIL),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC0-1.0", "Licensed under CC0 1.0."),
    ("Apache-2.0", APACHE_HEAD), ("Apache-2.0", APACHE_HEAD.replace("http:", "https:")), ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("MPL-2.0", MPL_HEAD), ("MPL-2.0", MPL_HEAD.replace("http:", "https:")), *_gnu_heads(), *_whole_texts(),
    *[("Unlicense", UNLICENSE + f"\n\nFor more information, please refer to <{at}://{host}>" * bool(host)) for at in ("http", "https") for host in ("", "unlicense.org", "unlicense.org/")],
    *[(i, f"SPDX-License-Identifier: {i}") for i in (
        "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later",
        "MPL-2.0", "EPL-1.0", "EPL-2.0", "Unlicense", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0")],
)
# Spellings that count as one.
SPELLINGS = (("licence", "license"), ("sub license", "sublicense"), ("favour", "favor"), ("organisation", "organization"), ("initialise", "initialize"),
             ("utilisation", "utilization"), ("whilst", "while"), ("acknowledgement", "acknowledgment"), ("non infringement", "noninfringement"),
             ("merchantibility", "merchantability"), ("copyright owner", "copyright holder"), ("per cent", "percent"), ("v2 0", "version 2 0"))
COPYRIGHT = r"^[^\p{L}\p{N}(©]*(copyright\b|\(c\)|©).*|^[^\p{L}\p{N}]*all rights reserved[^\p{L}\p{N}]*$"
PLAIN = r"[^\p{L}\p{N}]+"


def canonical_line(line: Column) -> Column:
    """The canonical form of one line; empty for a copyright line, also in a comment, and for 'all rights reserved'."""
    low = F.lower(line)
    text = F.trim(F.regexp_replace(low, PLAIN, " "))
    for said, same in SPELLINGS:
        text = F.replace(text, F.lit(said), F.lit(same))
    return F.when(low.rlike(COPYRIGHT), F.lit("")).otherwise(text)


def canonical_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), canonical_line), lambda x: x != "")


def listed(spark: SparkSession) -> DataFrame:
    """``licence, text`` of the default list."""
    return spark.createDataFrame([(i, t) for i, t in KNOWN], "licence string, text string")


def known(rows: DataFrame) -> DataFrame:
    """``digest, licence`` of a list of ``licence, text``; canonical forms that coincide count once."""
    digest = F.sha2(F.array_join(canonical_lines(F.col("text")), " "), 256)
    return rows.select(digest.alias("digest"), "licence").groupBy("digest").agg(F.min("licence").alias("licence"))


def scan(docs: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """``doc_id, scope, licence, line``: documents that are a licence as a whole (``line`` null), and lines that are a notice.

    ``line`` counts lines with any content, from 1. ``texts`` (``licence, text``) takes the place of the default list.
    """
    lines = docs.select("doc_id", canonical_lines(F.col("text")).alias("lines")).where(F.size("lines") > 0)
    whole = F.struct(F.lit(None).cast("int").alias("line"), F.sha2(F.array_join("lines", " "), 256).alias("digest"))
    each = F.when(F.size("lines") > 1, F.transform("lines", lambda x, i: F.struct((i + 1).alias("line"), F.sha2(x, 256).alias("digest")))).otherwise(
        F.array().cast("array<struct<line:int,digest:string>>"))
    units = lines.select("doc_id", F.explode(F.concat(F.array(whole), each)).alias("u")).select("doc_id", "u.line", "u.digest")
    # The default list is a constant of this module: some hundred rows, whatever the corpus.
    digests = F.broadcast(known(listed(docs.sparkSession))) if texts is None else known(texts)
    hits = units.join(digests, "digest")
    return hits.select("doc_id", F.when(F.col("line").isNull(), "text").otherwise("line").alias("scope"), "licence", "line")
