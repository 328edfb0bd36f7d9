"""Lines as notices have them, with the labels that they should and shouldn't get."""

from gaugeflow.llm import licenses

#: label: lines of which each has to get it. A line may get further labels of the same family.
WANTED = {
    "gpl": ["GPLv3", "License: GPLv2", "GPL-3.0-or-later", "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-3.0-or-later", "released under the GNU GPL v3", "licensed under the GPL", "GNU General Public License, version 2",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "See the GNU General Public License for more details.", "GPL-licensed code",
            "https://www.gnu.org/licenses/gpl-3.0.html"],
    "lgpl": ["LGPLv3", "LGPLv2.1", "LGPL-2.1+", "SPDX-License-Identifier: LGPL-2.1-only", "GNU Lesser General Public License v3", "available under the LGPL license", "https://www.gnu.org/licenses/lgpl-3.0.html"],
    "agpl": ["AGPLv3", "SPDX-License-Identifier: AGPL-3.0-only", "GNU Affero General Public License version 3", "licensed under the AGPL", "distributed under the GNU AGPL v3", "https://www.gnu.org/licenses/agpl-3.0.html"],
    "gfdl": ["GNU Free Documentation License", "under the terms of the GNU Free Documentation License, Version 1.3", "with no Invariant Sections, no Front-Cover Texts", "SPDX-License-Identifier: GFDL-1.3"],
    "mit": ["MIT-licensed", "MIT License", "The MIT License (MIT)", "under the terms of the MIT", "License: MIT", "SPDX-License-Identifier: MIT", "Released under the MIT licence.", "Licensed under MIT.", "an MIT-style license", "Expat license", "https://opensource.org/licenses/MIT",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"],
    "apache": ["Apache 2.0", "Apache License 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")", "SPDX-License-Identifier: Apache-2.0", "ASL 2.0", "Apache-2.0 licensed", "http://www.apache.org/licenses/LICENSE-2.0", "License: Apache-2.0", "Apache Software License"],
    "bsd": ["BSD license", "a BSD-style license", "released under BSD", "FreeBSD License", "Redistribution and use in source and binary forms, with or without modification, are permitted provided"],
    "bsd-2-clause": ["BSD 2-Clause License", "SPDX-License-Identifier: BSD-2-Clause", "Simplified BSD License"],
    "bsd-3-clause": ["BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause", "New BSD License", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"],
    "0bsd": ["BSD Zero Clause License", "Zero-Clause BSD", "SPDX-License-Identifier: 0BSD", "0BSD license"],
    "isc": ["ISC License", "License: ISC", "SPDX-License-Identifier: ISC", "released under the ISC license", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "mpl": ["Mozilla Public License 2.0", "MPL 2.0", "SPDX-License-Identifier: MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "http://mozilla.org/MPL/2.0/"],
    "epl": ["Eclipse Public License v2.0", "SPDX-License-Identifier: EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "https://www.eclipse.org/legal/epl-2.0/"],
    "cddl": ["CDDL 1.0", "SPDX-License-Identifier: CDDL-1.0", "Common Development and Distribution License"],
    "unlicense": ["The Unlicense", "SPDX-License-Identifier: Unlicense", "This is free and unencumbered software released into the public domain.", "For more information, please refer to <https://unlicense.org>"],
    "cc0": ["Creative Commons Zero", "CC0 1.0 Universal", "SPDX-License-Identifier: CC0-1.0", "CC Zero license", "licensed under CC0", "https://creativecommons.org/publicdomain/zero/1.0/"],
    "cc-by": ["CC BY 4.0", "Creative Commons Attribution 4.0 International", "Attribution 4.0 International", "SPDX-License-Identifier: CC-BY-4.0", "https://creativecommons.org/licenses/by/4.0/", "Creative Commons Attribution License"],
    "cc-by-sa": ["CC BY-SA 3.0", "Attribution-ShareAlike 3.0 Unported", "Creative Commons Attribution-ShareAlike License", "SPDX-License-Identifier: CC-BY-SA-4.0", "https://creativecommons.org/licenses/by-sa/4.0/"],
    "cc-by-nc": ["Attribution-NonCommercial 4.0", "CC BY-NC 4.0", "licensed under CC-BY-NC", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc-by-nd": ["Attribution-NoDerivatives 4.0 International", "CC BY-ND 4.0"],
    "cc-by-nc-sa": ["Attribution-NonCommercial-ShareAlike 4.0 International", "CC BY-NC-SA 4.0"],
    "cc-by-nc-nd": ["Attribution-NonCommercial-NoDerivatives 4.0 International", "CC BY-NC-ND 4.0"],
    "public-domain": ["This work is in the public domain.", "dedicated to the public domain", "Public Domain License"],
    "boost": ["Boost Software License 1.0", "Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"],
    "python": ["Python Software Foundation License", "SPDX-License-Identifier: PSF-2.0", "released under the Python license"],
    "ruby": ["Ruby License", "Ruby's licence"], "php": ["PHP License", "SPDX-License-Identifier: PHP-3.01"], "perl": ["under the same terms as Perl itself", "Perl License"],
    "elastic": ["Elastic License 2.0", "SPDX-License-Identifier: Elastic-2.0"], "bsl": ["Business Source License 1.1", "SPDX-License-Identifier: BUSL-1.1"], "sspl": ["Server Side Public License", "SSPL v1"],
    "zlib": ["zlib license", "SPDX-License-Identifier: Zlib", "zlib/libpng License"], "artistic": ["Artistic License 2.0", "SPDX-License-Identifier: Artistic-2.0"], "wtfpl": ["WTFPL license", "Do What The Fuck You Want To Public License"],
    "ms-pl": ["Microsoft Public License", "SPDX-License-Identifier: MS-PL"], "ofl": ["SIL Open Font License 1.1", "OFL 1.1"], "eupl": ["EUPL 1.2", "European Union Public Licence"], "cecill": ["CeCILL-B license", "CeCILL 2.1"],
    "osl": ["Open Software License 3.0", "SPDX-License-Identifier: OSL-3.0"], "afl": ["Academic Free License 3.0"], "upl": ["Universal Permissive License 1.0"], "ncsa": ["University of Illinois/NCSA Open Source License", "SPDX-License-Identifier: NCSA"],
    "odbl": ["Open Database License", "made available under the ODbL", "SPDX-License-Identifier: ODbL-1.0"], "ogl": ["Open Government Licence v3.0"], "w3c": ["W3C Software Notice and License"], "openssl": ["OpenSSL License"], "postgresql": ["PostgreSQL License"],
    "lppl": ["LaTeX Project Public License", "LPPL 1.3c"], "proprietary": ["Confidential and proprietary", "proprietary software", "Unauthorized copying of this file, via any medium"], "eula": ["End-User License Agreement"],
    "dual": ["This library is dual-licensed."], "json": ["The Software shall be used for Good, not Evil."], "beerware": ["THE BEER-WARE LICENSE"], "commons-clause": ["Commons Clause License Condition v1.0"], "apsl": ["Apple Public Source License"],
    "noncommercial": ["for non-commercial use only"], "reserved": ["All rights reserved."], "copyright": ["Copyright (c) 2021 The Authors"], "no-warranty": ["provided as is, without warranty of any kind"], "vim": ["Vim License"],
}

#: Lines that speak of the same words and grant nothing.
NONE = [
    "python 3 is easy", "ruby 2 and php 7 run here", "perl 5 script", "boost 2 the engine", "elastic 7 search cluster", "Er kam mit 20 Jahren", "Apache 2.4 is a web server", "the Apache helicopter", "zlib 1.2 was found to leak", "openssl 3 is out",
    "postgresql 16 on port 5432", "w3c 2 drafts", "the artistic director", "an artistic 2 act play", "open software 3 days a week", "open database 2 times", "open government 2 go", "mit 3 Freunden", "MIT 6 courses", "he gave a license to kill",
    "a driving license", "licensed plumber", "the general public was invited", "creative people in common", "no attribution was given", "attribution of the quote", "attribution 4 works", "the public sector", "a domain of the public", "mozilla firefox 2 browser",
    "the eclipse of 2024", "an elastic band", "boost your energy", "the ruby ring", "a python ate it", "pearl and perl", "php developers wanted", "a bsd machine", "freebsd 13 server", "he is an expat", "the vim editor", "latex gloves", "a beer and wares",
    "under the terms of the treaty", "released under pressure", "distributed under the table", "available under python 3", "the unlicensed driver", "dual core chips", "end of the user story", "business source of income", "server side code", "json 2 parse", "source and binary",
]


def test_notices_get_their_labels_and_others_none(spark):
    lines = [(label, line) for label, group in WANTED.items() for line in group] + [("", line) for line in NONE]
    assert len(lines) - len(NONE) >= 150 and len(NONE) >= 50
    found = licenses.scan_licenses(spark.createDataFrame(lines, "want string, text string").repartition(4)).collect()
    missed = [(r["want"], r["text"], sorted({d["label"] for d in r["detections"]})) for r in found if r["want"] and r["want"] not in {d["label"] for d in r["detections"]}]
    false = [(r["text"], sorted({d["label"] for d in r["detections"]})) for r in found if not r["want"] and r["detections"]]
    assert not missed and not false, (missed, false)


def test_places_of_repeated_and_nested_matches(spark):
    text = "MIT License and MIT License. SPDX-License-Identifier: MIT; GPLv3 GPLv3"
    places = [(d["first"], d["end"], d["label"]) for d in licenses.scan_licenses(spark.createDataFrame([(text,)], "text string")).first()["detections"]]
    assert places == [(0, 2, "mit"), (3, 5, "mit"), (5, 9, "mit"), (9, 10, "gpl"), (10, 11, "gpl")]
