"""Licence rules as ordered sentences, in the wording of the public licence texts.

A rule is (licence, sentences). Sentences are compared after normalisation, so case,
punctuation, wrapping and comment marks do not matter here. A list may hold both a rule
and a longer rule that begins like it.
"""

from __future__ import annotations

import re

_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"
_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"
_BSD = [
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
]
_FREE, _FREE_LIBRARY = "This program is free software", "This library is free software"
_UNDER = "you can redistribute it and/or modify it under the terms of the GNU {} License as published by the Free Software Foundation"
_LATER = "either version {} of the License, or (at your option) any later version"


def _gnu(name: str, version: str, first: str = _FREE) -> tuple[list[str], list[str]]:
    """A header's sentences, where a comma and where a semicolon stands before "either"."""
    return [first, f"{_UNDER.format(name)}, {_LATER.format(version)}"], [first, _UNDER.format(name), _LATER.format(version)]


RULES: dict[str, tuple[str, list[str]]] = {
    "apache-2.0-line": ("Apache-2.0", ["Licensed under the Apache License, Version 2.0"]),
    "apache-2.0-header": ("Apache-2.0", ["Licensed under the Apache License, Version 2.0 (the \"License\")", "you may not use this file except in compliance with the License", "You may obtain a copy of the License at"]),
    "mit-line": ("MIT", ["Released under the MIT License"]),
    "mit-text": ("MIT", [_GRANT, _NOTICE]),
    "mit-0-text": ("MIT-0", [_GRANT.removesuffix(", subject to the following conditions")]),
    "isc-text": ("ISC", ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"]),
    "0bsd-text": ("0BSD", ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"]),
    "gpl-3.0-line": ("GPL-3.0-only", ["This work is licensed under the GNU General Public License version 3"]),
    "gpl-3.0-header": ("GPL-3.0-or-later", _gnu("General Public", "3")[0]),
    "gpl-3.0-header-semicolon": ("GPL-3.0-or-later", _gnu("General Public", "3")[1]),
    "gpl-2.0-header": ("GPL-2.0-or-later", _gnu("General Public", "2")[0]),
    "gpl-2.0-header-semicolon": ("GPL-2.0-or-later", _gnu("General Public", "2")[1]),
    "agpl-3.0-header": ("AGPL-3.0-or-later", _gnu("Affero General Public", "3")[0]),
    "lgpl-3.0-header": ("LGPL-3.0-or-later", _gnu("Lesser General Public", "3")[0]),
    "lgpl-2.1-header": ("LGPL-2.1-or-later", _gnu("Lesser General Public", "2.1", _FREE_LIBRARY)[0]),
    "lgpl-2.1-header-semicolon": ("LGPL-2.1-or-later", _gnu("Lesser General Public", "2.1", _FREE_LIBRARY)[1]),
    "mpl-2.0-header": ("MPL-2.0", ["This Source Code Form is subject to the terms of the Mozilla Public License, v", "2.0"]),
    "epl-2.0-header": ("EPL-2.0", ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"]),
    "bsl-1.0-line": ("BSL-1.0", ["Distributed under the Boost Software License, Version 1.0"]),
    "zlib-text": ("Zlib", ["This software is provided 'as-is', without any express or implied warranty", "In no event will the authors be held liable for any damages arising from the use of this software"]),
    "unlicense-text": ("Unlicense", ["This is free and unencumbered software released into the public domain"]),
    "wtfpl-text": ("WTFPL", ["Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed"]),
    "cc0-1.0-text": ("CC0-1.0", ["To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"]),
    "cc-by-4.0-line": ("CC-BY-4.0", ["Licensed under CC BY 4.0"]),
    "cc-by-sa-4.0-line": ("CC-BY-SA-4.0", ["Licensed under CC BY-SA 4.0"]),
    "cc-by-nc-4.0-line": ("CC-BY-NC-4.0", ["Licensed under CC BY-NC 4.0"]),
    "cc-by-4.0-text": ("CC-BY-4.0", ["This work is licensed under a Creative Commons Attribution 4.0 International License"]),
    "cc-by-sa-4.0-text": ("CC-BY-SA-4.0", ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"]),
    "cc-by-nc-4.0-text": ("CC-BY-NC-4.0", ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"]),
    "cc-by-nd-4.0-text": ("CC-BY-ND-4.0", ["This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"]),
    "bsd-2-clause": ("BSD-2-Clause", _BSD),
    "bsd-3-clause": ("BSD-3-Clause", [*_BSD, "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"]),
    "rights-reserved": ("LicenseRef-all-rights-reserved", ["All rights reserved"]),
} | {
    f"spdx-{name.lower()}": (name, ["SPDX-License-Identifier", name])
    for name in ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "AGPL-3.0-or-later", "MPL-2.0", "CC0-1.0", "Unlicense")
}


def normalise(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def identifiers(rules: dict[str, tuple[str, list[str]]]) -> dict[str, str]:
    """An identifier for each distinct normalised sentence: its first rule and its place there."""
    out: dict[str, str] = {}
    for rule, (_, sentences) in rules.items():
        for k, sentence in enumerate(sentences):
            out.setdefault(normalise(sentence), f"{rule}.{k}")
    return out
