"""Published notices and tags of licences, with the licence that each means."""

import pytest

from tallyspark.llm import licenses

GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
GPL2 = """ * This program is free software; you can redistribute it and/or modify it under the
 * terms of the GNU General Public License as published by the Free Software Foundation;
 * either version 2 of the License, or (at your option) any later version."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
MIT = """MIT License

Copyright (c) 2020 Jo Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice.
2. Redistributions in binary form must reproduce the above copyright notice.
{}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS WARRANTIES ARE DISCLAIMED."""
CASES = [
    ("SPDX-License-Identifier: MIT", "MIT", ""),
    ("// SPDX-License-Identifier: (MIT OR Apache-2.0)", "MIT,Apache-2.0", ""),
    ("# SPDX-License-Identifier: GPL-2.0+\n# SPDX-License-Identifier: GPL-2.0+", "GPL-2.0-or-later", ""),
    ("/* SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note */", "GPL-2.0-only", "Tag:linux-syscall-note;"),
    ("SPDX-License-Identifier: LicenseRef-Acme", "", "Tag:licenseref-acme;"),
    ("Released under the MIT License. Released under the MIT License. Released under the MIT License.", "MIT", ""),
    ("This project is licensed under the MIT License - see the LICENSE file for details.", "MIT", ""),
    ("It is licensed under the MIT license (see LICENSE).", "MIT", ""),
    ("MIT License", "MIT", ""),
    ("License: GPL-3.0-or-later", "GPL-3.0-or-later", ""),
    ("License: see below", "", ""),
    (GPL, "GPL-3.0-or-later", ""),
    (GPL2, "GPL-2.0-or-later", ""),
    (GPL.replace("General", "Affero General"), "AGPL-3.0-or-later", ""),
    (GPL2.replace("General", "Lesser General").replace("version 2 ", "version 2.1 "), "LGPL-2.1-or-later", ""),
    ("Licensed under GPLv3.", "GPL-3.0-only", ""),
    (APACHE, "Apache-2.0", ""),
    (MIT, "MIT", ""),
    (BSD.format("3. Neither the name of the holder nor the names of its contributors may be used to endorse or promote products."), "BSD-3-Clause", ""),
    (BSD.format(""), "BSD-2-Clause", ""),
    ("Licensed under the 3-clause BSD license.", "BSD-3-Clause", ""),
    ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this file, you can get one.", "MPL-2.0", ""),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the notice appears.", "ISC", ""),
    ("This software is provided 'as-is', without any express or implied warranty.\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to this.", "Zlib", ""),
    ("Distributed under the Boost Software License, Version 1.0.", "BSL-1.0", ""),
    ("This work is licensed under CC BY-SA 4.0.\nOr: licensed under a Creative Commons Attribution 4.0 International License.", "CC-BY-SA,CC-BY", ""),
    ("This is free and unencumbered software released into the public domain.", "Unlicense", ""),
    ("Licensed under MIT.", "MIT", ""),
    ("This project is MIT licensed.", "MIT", ""),
    ("Dual licensed under MIT and Apache-2.0", "MIT,Apache-2.0", ""),
    ("License: GPLv3", "GPL-3.0-only", ""),
    ("License: Apache 2.0", "Apache-2.0", ""),
    ("Released under the terms of the MIT Licence.", "MIT", ""),
    ("GNU GPL v3", "GPL-3.0-only", ""),
    ("CC BY 4.0", "CC-BY-4.0", ""),
    ("Mozilla Public License Version 2.0", "MPL-2.0", ""),
    ("Licensed under either of Apache License, Version 2.0 or MIT license at your option.", "Apache-2.0,MIT", ""),
    ("LGPL Version 2.1", "LGPL-2.1-only", ""),
    ("The code is available under the GNU General Public License version 2 or later or the BSD 3-Clause license", "GPL-2.0-or-later,BSD-3-Clause", ""),
    ("We discussed the MIT license and its history at length.", "", ""),
    ("The mitigation is licensed to operate.", "", ""),
    ("(c) 2020 Jo. All rights reserved.\n© 2021 Jo", "", ""),
    ("Licensed under the Frobnicate licence.", "", "Unknown;"),
    ("The driver has no license to speed, and the permission was given.", "", ""),
    (None, "", ""),
    ("", "", ""),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(k, text) for k, (text, _, _) in enumerate(CASES)]
    return {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


@pytest.mark.parametrize("k", range(len(CASES)))
def test_notice(found, k):
    text, wanted, unmatched = CASES[k]
    assert (found[k].licenses, found[k].unmatched) == (wanted, unmatched), (text, found[k])


def test_copyright_lines_are_sentences(found):
    k = next(k for k, c in enumerate(CASES) if (c[0] or "").startswith("(c) 2020"))
    assert found[k].sentences == "Copyright;AllRights;Copyright;"


def test_notices_equal_sql(spark, found):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(k, text) for k, (text, _, _) in enumerate(CASES)])
    assert {r[0]: r for r in con.execute(licenses.SQL).fetchall()} == {k: tuple(r) for k, r in found.items()}


def test_every_sentence_has_a_rule():
    """No identifier but those that say nothing alone is without a rule."""
    rules = "".join(p for _, p in licenses.RULES)
    assert [n for n, _ in licenses.SENTENCES if f"<{n}>" not in rules] == ["Unknown"]
