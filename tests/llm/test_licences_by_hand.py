"""License scan: one text written by hand for each licence, and whole licence files where the machine has them."""

from pathlib import Path

import pytest

from siltstone.llm import licenses

GPL_TAIL = "\n\nThis program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."

BY_HAND = [
    ("GPL-2.0", "# Copyright (C) 2009 Some Body\n#\n# This program is free software; you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation; either version 2 of the License, or\n# (at your option) any later version."),
    ("GPL-2.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version." + GPL_TAIL),
    ("GPL-2.0", "/* This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation. */"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version." + GPL_TAIL),
    (None, "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 1, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("Apache-2.0", "// Licensed under the Apache License, Version 2.0 (the \"License\");\n// you may not use this file except in compliance with the License.\n// You may obtain a copy of the License at\n//\n//     http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc."),
    ("GPL-2.0", "\t\t    GNU GENERAL PUBLIC LICENSE\n\t\t       Version 2, June 1991\n\n Copyright (C) 1989, 1991 Free Software Foundation, Inc.,"),
    ("MIT", "// SPDX-License-Identifier: MIT\nint main() {}"),
    ("Apache-2.0", "# SPDX-License-Identifier: Apache-2.0"),
    ("GPL-2.0", "/* SPDX-License-Identifier: GPL-2.0-or-later */"),
    ("BSD-3-Clause", "# SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "# SPDX-License-Identifier: BSD-2-Clause"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC0-1.0", "Creative Commons Legal Code\nCC0 1.0 Universal\n\nCREATIVE COMMONS CORPORATION IS NOT A LAW FIRM"),
    ("CC-BY-SA-4.0", "Except where noted, see below.\nThis work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software, either in source code form or as a compiled\nbinary, for any purpose, commercial or non-commercial, and by any\nmeans."),
    ("ISC", "Permission to use, copy, modify, and distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."),
    (None, "The weather report, version 2 of the text, was published by the foundation under no licence at all."),
]


def test_by_hand(spark):
    df = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(BY_HAND)], "doc_id long, text string")
    got = {r.doc_id: r.license for r in licenses.op8(df).collect()}
    assert {i: got[i] for i in got if got[i] != BY_HAND[i][0]} == {}


def test_ties_between_templates_go_to_the_first(spark):
    templates = [("A", "one two three four"), ("B", "one two three four"), ("C", "one two three five")]
    df = spark.createDataFrame([(1, "one two three four"), (2, "one two three five"), (3, "one two three four")], "doc_id long, text string")
    got = {r.doc_id: (r.license, r.template) for r in licenses.scan_licenses(df, templates=templates).where("unit = 'line 0'").collect()}
    assert got == {1: ("A", 0), 2: ("C", 2), 3: ("A", 0)}


FILES = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}


@pytest.mark.skipif(not Path("/usr/share/common-licenses/GPL-3").exists(), reason="no licence files here")
def test_whole_files(spark):
    held = [name for name in FILES if Path(f"/usr/share/common-licenses/{name}").exists()]
    df = spark.createDataFrame([(i, Path(f"/usr/share/common-licenses/{name}").read_text()) for i, name in enumerate(held)], "doc_id long, text string")
    assert {held[r.doc_id]: r.license for r in licenses.op8(df).collect()} == {name: FILES[name] for name in held}
