from lumenary.llm import licenses
from lumenary.llm.registry import QUERIES

from .conftest import SF, sorted_rows

MIT = """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""


def rows():
    return [
        (1, MIT), (2, "Text. Licensed under the Apache License, Version 2.0. More text."), (3, "nothing here"), (4, None), (5, ""), (6, "This work is licensed under the GNU General Public License version 3.\n"),
        (7, ("some words of filler. " * 20_000) + "\nLicensed under CC BY 4.0.\n"), (8, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: nothing."),
        (9, "All rights reserved."), (9, "All rights reserved."), (None, "Licensed under the MIT license. Licensed under CC-BY-NC-4.0."), (10, "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software."),
    ]


def test_rules_match_sequences_of_sentences(docs_of):
    got = {r.doc_id: r for r in licenses.scan(docs_of(rows())).collect()}
    assert got[1].licenses == "MIT" and got[1].n_unmatched == 0
    assert [got[k].licenses for k in (2, 3, 4, 5, 6, 7, 9)] == ["Apache-2.0", "", "", "", "GPL-3.0", "CC-BY-4.0", "Proprietary"]
    assert got[8].licenses == "" and got[8].n_unmatched == 1  # the first sentence of a rule alone
    assert got[10].licenses == "" and got[None].licenses == "MIT + CC-BY-NC-4.0" or got[None].licenses == "CC-BY-NC-4.0 + MIT"


def test_repeated_rows_and_no_rows(docs_of):
    assert licenses.scan(docs_of(rows())).filter("doc_id = 9").count() == 2
    assert licenses.scan(docs_of(rows()).limit(0)).count() == 0


def test_sql_twin(oracle, docs_of, spark):
    data = [r for r in rows() if r[0] is not None]
    assert sorted_rows(licenses.scan(docs_of(data))) == oracle(licenses.SQL, data)
    assert sorted_rows(QUERIES["op1_license_scan"](spark, SF)) == oracle(licenses.SQL)


def test_no_python_in_the_plan(docs_of):
    plan = licenses.scan(docs_of(rows()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


BSD_2 = """Copyright (c) 2020, Some Body
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{more}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
ENDORSE = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
FULL = {
    "MIT": MIT + '\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE\nAUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER\nLIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,\nOUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE\nSOFTWARE.\n',
    "BSD-2-Clause": BSD_2.format(more=""),
    "BSD-3-Clause": BSD_2.format(more=ENDORSE),
    "Apache-2.0": 'Copyright 2020 Some Body. All rights reserved.\n\nLicensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an "AS IS" BASIS,\nWITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\nSee the License for the specific language governing permissions and\nlimitations under the License.\n',
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n\nThis program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\nGNU General Public License for more details.\n",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.\n",
    "ISC": "Copyright (c) 2020, Some Body\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n",
}
SPDX = {"MIT": "MIT", "Apache-2.0": "Apache-2.0", "GPL-3.0-only": "GPL-3.0", "GPL-2.0-or-later": "GPL-2.0-or-later", "BSD-3-Clause": "BSD-3-Clause", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}


def test_whole_licences_give_their_name_alone(docs_of, oracle):
    data, want = [], {}

    def add(text, name):
        want[len(data)] = name
        data.append((len(data), text))

    for name, text in FULL.items():
        paragraphs = "\n\n".join(" ".join(p.split()) for p in text.split("\n\n"))
        for x in (text, paragraphs, "".join(f"# {y}\n" for y in text.split("\n")), "/*\n" + "".join(f" * {y}\n" for y in text.split("\n")) + " */", text.replace("\n", "\r\n"), "Some words before.\n\n" + text + "\nand after."):
            add(x, name)
    for tag, name in SPDX.items():
        for x in (f"// SPDX-License-Identifier: {tag}\ncode", f"/* SPDX-License-Identifier: {tag} */", f"# SPDX-License-Identifier:\t{tag}\r\nmore"):
            add(x, name)
    got = {r.doc_id: r.licenses for r in licenses.scan(docs_of(data)).collect()}
    assert {data[k][1]: got[k] for k in want if got[k] != want[k]} == {}
    assert sorted_rows(licenses.scan(docs_of(data))) == oracle(licenses.SQL, data)
