"""License scans by canonical digests.

Known licence texts and notices are brought to a canonical form - lower case,
no copyright lines, no punctuation, one spelling for words that have several,
single spaces - and digested. Documents are looked up by the same digest for
their entire text, for each paragraph and for each line, in a hash join. Only
units that hold a cue can match: every known text holds one, which is checked
when the table is made. A cue is a part of one word, and the canonical form
changes no letters of it but "licence" to "license", so raw text that matches
holds it too: the cue spares work and loses nothing.

Known are notices of all listed licences, the entire MIT, ISC, BSD and Unlicense
texts, the file headers of Apache, MPL and the GNU licences, and, as digests of
their canonical form alone, the entire Apache, GNU, MPL, CC0 and Artistic texts
(the longer ones also without what follows their terms). A table of further
licences can be given; no cue is asked for then.

Defined results: null and empty texts match nothing; rows that share an id are
added up; a null id yields a null id; of licences with one canonical text the
first name counts; a text of any length is one unit; an empty table yields no
rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of licences in notices, by identifier.
NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0 License", "Apache Software License 2.0"],
    "MIT": ["MIT License", "MIT Licence", "MIT"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License", "2-Clause BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License", "Modified BSD License", "3-Clause BSD License"],
    "ISC": ["ISC License"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GPL v2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GPL v3"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0"],
    "EPL-2.0": ["Eclipse Public License, version 2.0", "Eclipse Public License 2.0"],
    "Unlicense": ["Unlicense"],
    "CC0-1.0": ["CC0 1.0", "Creative Commons Zero 1.0"],
} | {
    f"CC-{'-'.join(kind.split('-'))}-{version}": [f"CC {kind} {version}", f"CC-{kind} {version}", f"CC-{kind}-{version}", f"Creative Commons {long} {version} International License", f"Creative Commons {long} {version}"]
    for kind, long in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
    for version in ("3.0", "4.0")
}
# How notices begin; {} is a licence name, with or without "the" or "a".
OPENINGS = [
    "licensed under {}", "released under {}", "distributed under {}", "published under {}", "available under {}", "made available under {}",
    "this work is licensed under {}", "this software is licensed under {}", "this file is licensed under {}", "this project is licensed under {}",
    "this work is released under {}", "this software is released under {}", "this document is licensed under {}", "license {}", "SPDX-License-Identifier {}",
]
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
# Entire short licences; {} is http or https.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": _BSD + _BSD_END,
    "BSD-3-Clause": _BSD + """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
""" + _BSD_END,
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <{}://unlicense.org/>""",
}
# The standard headers of files, for licences too long to be units.
HEADERS = {
    "Apache-2.0": ["""Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
{}://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"""],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at {}://mozilla.org/MPL/2.0/."],
} | {
    f"{short}-{version}": [
        f"This {what} is free software{mark} you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation{either} version {version.removesuffix('.0')} of the License, or (at your option) any later version."
        for what in ("program", "library", "software", "file")
        for mark, either in ((":", ", either"), ("; ", "; either"))
    ]
    for short, name, versions in (("GPL", "GNU General Public License", ("2.0", "3.0")), ("LGPL", "GNU Lesser General Public License", ("2.1", "3.0")), ("AGPL", "GNU Affero General Public License", ("3.0",)))
    for version in versions
}
# Digests of the canonical form of entire long licences, as their publishers distribute them.
WHOLE_DIGESTS = {
    "Apache-2.0": ["5572b388ddac6a11991356f8515c952cf2ae2c590afa4c155a129cedb11750fe", "ea8ed5219346d2135bf7ba18b81c96755ff59b231de0a33f03fbbc8c9899f1c6", "b58598936cf28723ee5724361c8d171020b558b41905d3d9dede50775c9a2f29"],
    "GPL-1.0": ["ec8a6b7d70e9f225b63d3962ed5b4721373f5535d7b967a06722b0d621f6892a", "af30c0af27b90ec812acdb040f3dcc944a87cd893456690efe35063f39e3eeeb", "74d0cd23803c9754c36f6ca0e1af411b418ed6b6564e757472bf0d870a1b5d1b"],
    "GPL-2.0": ["c230c00f329737cb7ce3d97a266318b4c9d4c1fd321335e592b2ce1112179b88", "178d586a448701f01712744f9de166175b5625d05f71dd532a3d694e2b935def", "ae49934a47b15ec36e1ce1eb7504b3439c29f0e9be2ed0f60ba20ad7124dcb7c"],
    "GPL-3.0": ["f3ab5ee40da170411ea6671f9845ada2aaba303ee57ba6086b373d1e66c9dc3f", "3d4de016a08e1d98b27dec755cdf4530b92807d97aaa185b32e12d52942b1943", "3dcf77ad8c25248618918aaff1de8a2cb80cea6ca922ef4a7a389cca96a7560b"],
    "LGPL-2.0": ["9b0b3105b96203f9d9e4b72d4b77951152156c88139302b5aedf6295e3ceaaa3", "e0de5033b5ad2a24c0a1a8b04f09e33038ffa62d2bef7178de2a3c6f5d56f499", "ff773d8d898dfc51ae2dbf3baa20700673e8ceb153b13d26c525af34a59adf0c"],
    "LGPL-2.1": ["ee01a49687158ed8316b65f56d1b93bf677fd57ed8f2e5470d49d09023cbe8e7", "666030c4f6ae6e32b4a1f542473e5bf790d855ea58f3b172a98612e7af3adda9", "e5ed2dcee45d0edc37dd215a451aaa08be207622d602df0dca9e1b3dfc65f6d0"],
    "LGPL-3.0": ["aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"],
    "MPL-1.1": ["88846eb6702a488d90fada09f552952c288f5fb9fbfd58a96e62f8a77a03325e"],
    "MPL-2.0": ["f7135931e9b6b2d14b0ee0d936f91569cf22ab982fed7984dc4f3614acb04c69"],
    "CC0-1.0": ["157f233e1cf037dd4dc24bd08eb90c2fbc3042ed8e88b5caf338e5df0e6a7abf"],
    "GFDL-1.2": ["fd8daf401001e9bd6dcd840e4ae6d37c7b890cd553749d6c9f2ac7a3377e6a7a"],
    "GFDL-1.3": ["df89ea16fd6daa85c045edd3629393648c9a42c7ece69466fe1b1b11d726b0d9"],
    "Artistic-1.0": ["cc2cd6cccfacd5fb622fb0e9b9a373fa9dcb86a8c152213a2b856dfbe24fe304"],
}
# Words with several spellings; the right one counts.
SPELLINGS = {"licence": "license", "licences": "licenses", "licenced": "licensed", "licencing": "licensing", "sub-license": "sublicense", "noncommercial": "non commercial", "non-commercial": "non commercial", "sharealike": "share alike", "share-alike": "share alike", "noderivatives": "no derivatives", "organisation": "organization", "authorised": "authorized", "&": "and", "v2.0": "version 2.0", "v2.1": "version 2.1", "v3.0": "version 3.0", "v2": "version 2", "v3": "version 3"}
# Single words, since known texts are found whatever stands between words.
CUES = ["licen", "under", "permission", "redistribution"]

_COPYRIGHT = r"(?m)^\s*(copyright|\(c\)|©|all rights reserved).*$"
_MARKS = r"[^\p{L}\p{N}.&-]+"
_LOOSE = r"(?<![\p{N}])\.|\.(?![\p{N}])|(^|(?<= ))-|-(?= |$)"


def canonical(text: str) -> str:
    """The same steps as ``canonical_column``, for the known texts."""
    import regex

    out = regex.sub(_COPYRIGHT, " ", text.lower())
    out = regex.sub(_LOOSE, " ", regex.sub(_MARKS, " ", out))
    for word, one in SPELLINGS.items():
        out = regex.sub(rf"(?<![^ ]){re.escape(word)}(?![^ ])", one, out)
    return regex.sub(" +", " ", out.replace("-", " ")).strip()


def canonical_column(text: Column) -> Column:
    out = F.regexp_replace(F.lower(text), _COPYRIGHT, " ")
    out = F.regexp_replace(F.regexp_replace(out, _MARKS, " "), _LOOSE, " ")
    for word, one in SPELLINGS.items():
        out = F.regexp_replace(out, rf"(?<![^ ]){re.escape(word)}(?![^ ])", one)
    return F.trim(F.regexp_replace(F.replace(out, F.lit("-"), F.lit(" ")), " +", " "))


def _titles(licence: str) -> list[str]:
    return [f"{licence} License", *NAMES[licence]]


def known_digests() -> dict[str, str]:
    """Digest of each canonical text -> licence identifier."""
    out = {}
    for licence, names in NAMES.items():
        for name in [*names, licence]:
            for article in ("", "the ", "a "):
                for opening in OPENINGS:
                    for end in ("", " International", " License"):
                        text = canonical(opening.format(article + name + end))
                        out.setdefault(hashlib.sha256(text.encode()).hexdigest(), licence)
                        if not any(c in text for c in CUES):
                            raise ValueError(f"no cue in {text!r}")
    whole = [(licence, part) for licence, text in TEXTS.items() for title in _titles(licence) for part in (text, f"{title}\n{text}", f"The {title}\n{text}")]
    whole += [(licence, text) for licence, texts in HEADERS.items() for text in texts]
    for licence, text in whole:
        for scheme in ("http", "https"):
            one = canonical(text.replace("{}", scheme))
            if not any(c in one for c in CUES):
                raise ValueError(f"no cue in {one!r}")
            out[hashlib.sha256(one.encode()).hexdigest()] = licence
    for licence, digests in WHOLE_DIGESTS.items():
        out |= dict.fromkeys(digests, licence)
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", licences: DataFrame | None = None) -> DataFrame:
    """(doc_id, licence, units, whole): units of text that are that licence, and whether the entire text is.

    ``licences``: a table (licence, text) of further licences; it is joined by digest, whatever its size.
    """
    spark = docs.sparkSession
    known = F.broadcast(spark.createDataFrame(sorted(known_digests().items()), "digest string, licence string"))  # a fixed table of some thousand digests
    if licences is not None:
        own = licences.where("licence is not null and text is not null").select(F.sha2(canonical_column(F.col("text")), 256).alias("digest"), "licence")
        known = own.unionByName(known).groupBy("digest").agg(F.min("licence").alias("licence"))
    has_cue = lambda c: F.lit(True) if licences is not None else F.greatest(*(F.contains(F.lower(c), F.lit(x)) for x in CUES))
    kept = docs.where(F.col(text_col).isNotNull() & has_cue(F.col(text_col))).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("body"))
    lines = F.filter(F.split("body", "\n"), has_cue)
    parts = F.filter(F.split("body", r"\n\s*\n"), lambda p: has_cue(p) & F.contains(p, F.lit("\n")))
    whole = F.when(F.contains("body", F.lit("\n")), F.array("body")).otherwise(F.array().cast("array<string>"))
    units = kept.select(
        "doc_id",
        F.explode(F.concat(
            F.transform(whole, lambda x: F.struct(x.alias("unit"), F.lit(True).alias("whole"))),
            F.transform(F.filter(parts, lambda p: p != F.col("body")), lambda x: F.struct(x.alias("unit"), F.lit(False).alias("whole"))),
            F.transform(lines, lambda x: F.struct(x.alias("unit"), (x == F.col("body")).alias("whole"))),
        )).alias("u"),
    )
    digests = units.select("doc_id", F.sha2(canonical_column(F.col("u.unit")), 256).alias("digest"), F.col("u.whole").alias("whole"))
    hits = digests.join(known, "digest")
    return hits.groupBy("doc_id", "licence").agg(F.count("*").alias("units"), F.max("whole").alias("whole"))
