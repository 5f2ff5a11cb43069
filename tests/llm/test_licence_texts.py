"""Entire licences, file headers, and notices whatever their blanks."""

from geoloom.llm import license_scan as L

APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     https://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License."""
GPL = """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version."""


def test_texts_and_headers(spark):
    docs = [(f"w{k}", f"Copyright (c) 2020 A\n\n{t}".replace("{}", "https"), k) for k, t in L.TEXTS.items()]
    docs += [("apache", f"# Copyright 2020 A\n\n{APACHE}\n\nimport os\n", "Apache-2.0"), ("gpl", f"/* x.c\n\n{GPL}\n\n * more */", "GPL-3.0")]
    got = {(r.doc_id, r.licence): r.whole for r in L.scan(spark.createDataFrame([d[:2] for d in docs], "doc_id string, text string")).collect()}
    assert got == {(i, licence): i[0] == "w" for i, _, licence in docs}
    assert {"BSD-2-Clause", "BSD-3-Clause", "Unlicense"} <= set(L.TEXTS)


def test_cues_see_any_blanks(spark):
    lines = ["Published\tunder GPL v2", "Released  under CC BY 4.0", "Available under *MIT*"]
    got = {r.doc_id: r.licence for r in L.scan(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()}
    assert got == {0: "GPL-2.0", 1: "CC-BY-4.0", 2: "MIT"}
