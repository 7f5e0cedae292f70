import random

from conftest import rows

from loomspan.llm.licences import NAMES, Templates, expression, field_statements, file_statements, licences, token_distance

T = Templates(NAMES)


def test_distance():
    r = random.Random(2)
    for _ in range(400):
        a, b = (tuple(r.choices("xyz", k=r.randint(0, 7))) for _ in range(2))
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            p, d = d, [i]
            for j, y in enumerate(b, 1):
                d.append(min(p[j - 1] + (x != y), p[j] + 1, d[-1] + 1))
        assert token_distance(a, b) == d[-1]


def test_every_name_is_its_licence():
    for lic, names in NAMES.items():
        for n in [lic, *names, *(f"the {x}" for x in names), *(x.upper() for x in names), *(x.replace("License", "Licence") for x in names)]:
            assert T.nearest(n) == lic, n


def test_near_and_far():
    assert T.nearest("GNU General Public Licence, version 3 only") == "GPL-3.0"
    assert T.nearest("the GPL v3 or any later version") == "GPL-3.0"
    assert T.nearest("Mozilla Public Licens, v. 2.0") == "MPL-2.0"
    for t in ("see LICENSE file", "unknown", "NOASSERTION", "", "GNU General Public License, version 4", "Terms to be decided"):
        assert T.nearest(t) is None, t


def test_choices():
    for t in ("(MIT OR Apache-2.0)", "Apache-2.0/MIT", "apache2 or The MIT Licence", "either of version 2.0 of the Apache Licence or MIT terms", "Apache-2.0 or, at your option, the Expat (MIT) licence"):
        assert expression(t, T) == "Apache-2.0 OR MIT", t
    assert expression("GPL-2.0-or-later", T) == "GPL-2.0" and expression("GPLv3+ or MPL-2.0", T) == "GPL-3.0 OR MPL-2.0"


def test_texts():
    for t, want in {
        "# SPDX-License-Identifier:MPL-2.0 OR GPL-3.0\r\nx": {"GPL-3.0 OR MPL-2.0"},
        "<!-- Copyright (c) 2020 the x authors. Released under the New BSD License; keep this notice. -->": {"BSD-3-Clause"},
        "&lt;p&gt;Licensed under the Mozilla Public License, v. 2.0.&lt;/p&gt;": {"MPL-2.0"},
        "---\nname: x\nlicense: \"ASL 2.0\"\n---\ntext": {"Apache-2.0"},
        "Dieses Werk steht unter der Lizenz GNU GPL 2.": {"GPL-2.0"},
        "Distribué sous licence mit.": {"MIT"},
        "Publicado bajo la licencia CC BY 4.0. Más texto.": {"CC-BY-4.0"},
        "Use, change and share it as The Unlicense (public domain) allows.": {"Unlicense"},
        "Compare the licence texts of ISC and BSD-2-Clause in the report.": set(),
        "It lists packages whose licence is MIT or Apache-2.0.": set(),
        "The checker warns when a dependency is under the GPL-3.0. Replace any AGPL-3.0 library before shipping.": set(),
        "": set(),
    }.items():
        assert file_statements(t, T) == want, t
    assert file_statements("x " * 500_000 + "Licensed under MIT terms.", T) == {"MIT"}


def test_fields():
    for v, want in {
        None: set(), "": set(), "null": set(), "[]": set(), "{}": set(), '{"type": "NOASSERTION"}': set(), '{"license_type": null}': set(), "Expat": {"MIT"}, '"Expat"': {"MIT"}, '{"value": {"license_type": "isc"}}': {"ISC"},
        '{"type": "MIT", "license_file": {"path": "L", "head": "SPDX-License-Identifier: GPL-2.0-only"}}': {"MIT", "GPL-2.0"}, '{"type": "MIT"': set(),
    }.items():
        assert field_statements(v, T) == want, v


def test_status(spark):
    v = spark.createDataFrame(
        [(1, "a", None, None), (2, "a", "MIT", None), (3, "a", "ISC", None), (4, "b", None, "Licensed under ISC."), (5, "b", None, None), (6, None, None, None), (7, "c", "MIT", "Licensed under MIT terms.")],
        "id long, source_repo string, license string, raw_content string",
    ).selectExpr("*", "'x' AS entity", "'y' AS own")
    r = spark.createDataFrame([("a", "MIT"), ("b", '{"type": "MIT", "license_file": {"head": "Released under ISC."}}'), ("c", None)], "id string, license string")
    ref = spark.createDataFrame([(k,) for k in NAMES], "license_id string")
    assert rows(licences(v, r, ref)) == sorted([
        ("file", "1", "MIT", "inherited"), ("file", "2", "MIT", "stated"), ("file", "3", "ISC | MIT", "conflict"), ("file", "4", "ISC", "stated"), ("file", "5", "unknown", "unknown"), ("file", "6", "unknown", "unknown"), ("file", "7", "MIT", "stated"),
        ("repository", "a", "MIT", "stated"), ("repository", "b", "ISC | MIT", "conflict"), ("repository", "c", "unknown", "unknown"),
    ], key=repr)


MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute'
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice.\n"
BSD2 = '\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"'
BSD3 = "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."


def test_licence_texts_without_a_name():
    commented = "\n".join(f"// {line}" for line in MIT.replace(", ", ",\n").split("\n"))
    for t, want in {
        MIT: {"MIT"},
        commented: {"MIT"},
        "x = 1\n" * 1000 + MIT.replace("free of charge", "without any charge").upper(): {"MIT"},
        MIT[:70]: set(),
        BSD: set(),
        BSD + BSD2: {"BSD-2-Clause"},
        BSD + BSD2.replace("\n\n", BSD3 + "\n\n"): {"BSD-3-Clause"},
        BSD + BSD3: {"BSD-3-Clause"},
        "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/\n\nTERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION": {"Apache-2.0"},
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": {"AGPL-3.0"},
        "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish": {"Unlicense"},
    }.items():
        assert file_statements(t, T) == want, t


def test_reworded_headers():
    for t, want in {
        "This tool is made available under the MIT License.": {"MIT"},
        "Covered by the Apache License, Version 2.0.": {"Apache-2.0"},
        "# Licensed under the Apache License,\n# Version 2.0\nx = 1": {"Apache-2.0"},
        "Provided under the terms of MPL 2.0, which " + "means much " * 200: {"MPL-2.0"},
        "Subject to the conditions of the ISC licence.": {"ISC"},
        "You may copy this skill under version 2 of the GNU General Public License.": {"GPL-2.0"},
        "This is not licensed under the MIT License.": set(),
        "Licensed under the Apache License, Version 1.1.": set(),
        "The GPL-3.0 and the MIT License are compared under load.": set(),
        "-- Licensed under either of GNU GPLv3 or the Mozilla Public License, v\n-- 2.0.\nx": {"GPL-3.0 OR MPL-2.0"},
    }.items():
        assert file_statements(t, T) == want, t


def test_trees_decide_alone():
    t = Templates(NAMES)
    assert t.nearest("MIT") == "MIT" and t.nearest("Mozilla Public Licens, v. 2.0") == "MPL-2.0" and t.nearest("nothing of the kind") is None
    assert t.decided == {0: 1, 1: 1}
