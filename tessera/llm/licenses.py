"""op4: licence scan by canonical digests, with DataFrame functions alone.

A text's canonical form is in lower case, without copyright lines, with equivalent spellings made one, and with runs of
anything but letters and digits as one blank.  Its SHA-256 is hash-joined with the digests of known
licences.  Whole texts are looked up, and each single line too, as short notices stand on lines of their own.  Notices
that are broken over lines are met only where one of their lines names the licence by itself.
"""

from __future__ import annotations

from importlib.resources import files

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import lookup

# Public licence texts and notices, from the licences themselves.
MIT = """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """ISC License

Copyright (c) <year> <owner>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZLIB = """zlib License

Copyright (c) <year> <owner>

This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
{third}
THIS SOFTWARE IS PROVIDED BY THE {holders} AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE {holder} OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
THIRD = "3. Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
GNU = """This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {kind} License as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version.

This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} License for more details.

You should have received a copy of the GNU {kind} License along with this {what}{end}"""
ADDRESS = "; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA"
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."

# Whole texts in texts/, by id, and the names that notices use.
NAMES = {
    "MIT": ["MIT License", "MIT License (MIT)"],
    "ISC": ["ISC License"],
    "Zlib": ["zlib License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache 2.0", "Apache-2.0 License", "Apache License, Version 2.0 (the \"License\")"],
    "MPL-1.1": ["Mozilla Public License, version 1.1", "Mozilla Public License 1.1"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "MPL 2.0"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    **{f"{k}PL-{v}": [n for w in dict.fromkeys([v, v.removesuffix(".0")]) for n in (f"GNU {name} Public License, version {w}", f"GNU {name} Public License {w}", f"GNU {name} Public License v{w}", f"GNU {k}PL {w}", f"GNU {k}PLv{w}", f"{k}PL {w}", f"{k}PLv{w}")] for k, v, name in (("G", "1.0", "General"), ("G", "2.0", "General"), ("G", "3.0", "General"), ("LG", "2.0", "Library General"), ("LG", "2.1", "Lesser General"), ("LG", "3.0", "Lesser General"))},
    "GFDL-1.2": ["GNU Free Documentation License, version 1.2"],
    "GFDL-1.3": ["GNU Free Documentation License, version 1.3"],
}
OPENINGS = [f"{who}{verb} under {the}" for who in ("", "This work is ", "This project is ", "This software is ", "This program is ") for verb in ("Licensed", "Released", "Distributed") for the in ("", "the ", "the terms of the ")]
IN_FILES = ["Apache-2.0", "CC0-1.0", "GFDL-1.2", "GFDL-1.3", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0"]
END = "END OF TERMS AND CONDITIONS"


def _whole_texts() -> list[tuple[str, str]]:
    """Each text with and without its title, line of rights, numbers and appendix."""
    out = [("MIT", MIT), ("ISC", ISC), ("Zlib", ZLIB)]
    for i, text, titles in (("MIT", MIT, ("The MIT License", "The MIT License (MIT)")), ("ISC", ISC, ("The ISC License",)), ("Zlib", ZLIB, ("The zlib License",))):
        out += [(i, f"{t}\n{rights}\n{text.split(chr(10), 1)[1]}") for t in ("", text.split("\n")[0], *titles) for rights in ("", "All rights reserved.")]
    three = [(THIRD.format(name), holders, holder) for name, holders, holder in (("the copyright holder", "COPYRIGHT HOLDERS", "COPYRIGHT HOLDER"), ("the copyright holder", "COPYRIGHT HOLDERS", "COPYRIGHT OWNER"), ("the University", "REGENTS", "REGENTS"))]
    for i, thirds in (("BSD-2-Clause", [("", *x[1:]) for x in three]), ("BSD-3-Clause", three)):
        for third, holders, holder in thirds:
            body = BSD.format(third=third, holders=holders, holder=holder)
            for text in (body, body.replace("\n1. ", "\n").replace("\n2. ", "\n").replace("\n3. ", "\n")):
                out += [(i, f"{t}\n{rights}\n{text}") for t in ("", *(p + n for p in ("", "The ") for n in NAMES[i])) for rights in ("", "All rights reserved.")]
    for i in IN_FILES:
        text = (files(__package__) / "texts" / f"{i}.txt").read_text("utf-8")
        out.append((i, text))
        if END in text:
            terms = text[: text.index(END)]
            out += [(i, terms), (i, terms + END)]
    return out


def _notices() -> list[tuple[str, str]]:
    """Notices of a line, and the usual headers (whole, or the lines of theirs that name the licence)."""
    out = [(i, opening + name) for i, names in NAMES.items() for name in names for opening in OPENINGS]
    out += [(i, f"SPDX-License-Identifier: {i}{end}") for i in NAMES for end in (("", "+", "-only", "-or-later") if i.startswith(("GPL", "LGPL", "GFDL")) else ("",))]
    out += [("Apache-2.0", APACHE), ("Apache-2.0", "http://www.apache.org/licenses/LICENSE-2.0"), ("MPL-2.0", MPL), ("MPL-2.0", "License, v. 2.0. If a copy of the MPL was not distributed with this")]
    for i, kind, version, what in (("GPL-2.0", "General Public", "2", "program"), ("GPL-3.0", "General Public", "3", "program"), ("LGPL-2.1", "Lesser General Public", "2.1", "library"), ("LGPL-3.0", "Lesser General Public", "3", "library"), ("LGPL-3.0", "Lesser General Public", "3", "program")):
        out += [(i, GNU.format(what=what, kind=kind, version=version, end=end)) for end in (ADDRESS, ". If not, see <http://www.gnu.org/licenses/>.")]
    return out


KNOWN = _whole_texts() + _notices()

# A line that names a holder: with a sign or a year after the word (wrapped sentences can begin with the word too).
COPYRIGHT = "(?m)^[^a-z0-9©\n]*(copyright([^a-z0-9©\n]+by)?[^a-z0-9©\n]*(c\\)|©|year|yyyy|[0-9]{4})|©|\\(c\\)[^a-z0-9\n]*(year|yyyy|[0-9]{4}))[^\n]*$"
# Equivalent spellings, replaced in this order in lower-cased text.
SPELLINGS = [("licence", "license"), ("sub-license", "sublicense"), ("non-infringement", "noninfringement"), ("merchantibility", "merchantability"), ("acknowledgement", "acknowledgment"), ("&", " and "), ("https:", "http:")]


def canonical(text):
    """Column: the canonical form, still by line: '\\n' stays between lines."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT, "")
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.regexp_replace(out, "[^a-z0-9\n]+", " ")


def whole(lines):
    return F.btrim(F.regexp_replace(lines, "[ \n]+", " "))


def catalogue(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """digest, license_id of known texts, one row a digest (the least id where several share a text)."""
    rows = spark.createDataFrame(KNOWN if known is None else known, "license_id string, text string")
    return rows.select(F.sha2(whole(canonical(F.col("text"))), 256).alias("digest"), "license_id").groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, digest (of the whole canonical text), license_id (whose text it is, or null), notice_ids (sorted,
    comma-joined ids of lines that are known texts, or empty).

    One row per input row.  A null text has a null digest; an empty one the digest of nothing, which no licence
    has.  Repeated rows and null ids keep their own rows.  Reads doc_id and text alone.
    """
    text = F.col("text").cast("string")
    own = docs.select("doc_id", F.xxhash64(text).alias("at"), F.xxhash64(F.lit(1), text).alias("at2"), canonical(text).alias("lines"))
    entry = lambda digest, is_whole: F.struct(digest.alias("digest"), F.lit(is_whole).alias("is_whole"))
    lines = F.filter(F.array_distinct(F.transform(F.split("lines", "\n"), lambda x: F.btrim(x))), lambda x: x != "")
    looked_up = own.select("doc_id", "at", "at2", F.explode(F.concat(F.array(entry(F.sha2(whole(F.col("lines")), 256), True)), F.coalesce(F.transform(lines, lambda x: entry(F.sha2(x, 256), False)), F.array().cast("array<struct<digest:string,is_whole:boolean>>")))).alias("e"))
    # of lines only those that are known go on; a document's rows then meet by its id and text
    met = lookup(looked_up.select("doc_id", "at", "at2", "e.*"), known, ["digest"], ["at"], "left").filter("is_whole or license_id is not null")
    by_text = met.groupBy("doc_id", "at", "at2").agg(
        F.count_if("is_whole").alias("n"),
        F.max(F.when(F.col("is_whole"), F.col("digest"))).alias("digest"),
        F.max(F.when(F.col("is_whole"), F.col("license_id"))).alias("license_id"),
        F.array_join(F.array_sort(F.collect_set(F.when(~F.col("is_whole"), F.col("license_id")))), ",").alias("notice_ids"),
    )
    return by_text.select("doc_id", "digest", "license_id", "notice_ids", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("_")).drop("_")
