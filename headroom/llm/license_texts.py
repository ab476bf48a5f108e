"""Licence names, headers and texts: public wording, fixed values.

Short notices are made from names by ``PHRASES``; a notice counts only where it holds the
marks of its name.
"""

from __future__ import annotations

#: Licence, a name used for it, and the words a notice must hold to mean it.
NAMES = (
    ("AGPL-3.0", "GNU Affero General Public License, version 3", "affero"),
    ("Apache-2.0", "Apache License, Version 2.0", "apache"),
    ("Apache-2.0", "Apache-2.0 License", "apache"),
    ("BSD-2-Clause", "BSD 2-Clause License", "bsd 2"),
    ("BSD-3-Clause", "BSD 3-Clause License", "bsd 3"),
    ("BSL-1.0", "Boost Software License, Version 1.0", "boost"),
    ("CC-BY-4.0", "CC BY 4.0", "cc by"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International License", "creative commons attribution"),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0", "cc by nc"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "creative commons noncommercial"),
    ("CC-BY-SA-4.0", "CC BY-SA 4.0", "cc by sa"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "creative commons sharealike"),
    ("CC0-1.0", "CC0 1.0 Universal", "cc0"),
    ("GPL-2.0", "GNU General Public License, version 2", "gnu general public 2"),
    ("GPL-2.0", "GPL-2.0", "gpl 2"),
    ("GPL-3.0", "GNU General Public License, version 3", "gnu general public 3"),
    ("GPL-3.0", "GPL-3.0", "gpl 3"),
    ("ISC", "ISC License", "isc"),
    ("LGPL-2.1", "GNU Lesser General Public License, version 2.1", "gnu lesser 2"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3", "gnu lesser 3"),
    ("MIT", "MIT License", "mit"),
    ("MPL-2.0", "Mozilla Public License, version 2.0", "mozilla"),
    ("Unlicense", "Unlicense", "unlicense"),
    ("Zlib", "zlib License", "zlib"),
)

PHRASES = (
    "Licensed under {name}.",
    "Licensed under the {name}.",
    "Released under the {name}.",
    "Distributed under the terms of the {name}.",
    "This work is licensed under the {name}.",
    "This library is licensed under the {name}.",
    "This project is licensed under the {name} - see the LICENSE file for details.",
)
IDENTIFIER = "SPDX-License-Identifier: {licence}"

_NO_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""

_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
{third}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT
SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE
OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_GNU = """This {what} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by
the Free Software Foundation, either version {version} of the License, or (at your option) any later version.
This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.
You should have received a copy of the {name} along with this {what}. If not, see <https://www.gnu.org/licenses/>."""

_COPYING = """{name} Version {version} Copyright (C) {year} Free Software Foundation, Inc.
Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."""

#: Headers and texts; they need no marks.
TEXTS = (
    ("AGPL-3.0", _GNU.format(what="program", name="GNU Affero General Public License", version="3")),
    ("AGPL-3.0", _COPYING.format(name="GNU AFFERO GENERAL PUBLIC LICENSE", version="3, 19 November 2007", year="2007")),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License."""),
    ("Apache-2.0", """Apache License Version 2.0, January 2004 http://www.apache.org/licenses/
TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION
1. Definitions. "License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1
through 9 of this document. "Licensor" shall mean the copyright owner or entity authorized by the copyright owner that is
granting the License."""),
    ("BSD-2-Clause", _BSD.format(third="")),
    ("BSD-3-Clause", _BSD.format(third="""3. Neither the name of the copyright holder nor the names of its contributors may be used
to endorse or promote products derived from this software without specific prior written permission.""")),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("BSL-1.0", """Boost Software License - Version 1.0 - August 17th, 2003
Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying
documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software,
and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so."""),
    ("GPL-2.0", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software
Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."""),
    ("GPL-2.0", _COPYING.format(name="GNU GENERAL PUBLIC LICENSE", version="2, June 1991", year="1989, 1991")),
    ("GPL-3.0", _GNU.format(what="program", name="GNU General Public License", version="3")),
    ("GPL-3.0", _COPYING.format(name="GNU GENERAL PUBLIC LICENSE", version="3, 29 June 2007", year="2007")),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose is hereby granted."),
    ("LGPL-2.1", _GNU.format(what="library", name="GNU Lesser General Public License", version="2.1")),
    ("LGPL-2.1", _COPYING.format(name="GNU LESSER GENERAL PUBLIC LICENSE", version="2.1, February 1999", year="1991, 1999")),
    ("LGPL-3.0", _GNU.format(what="library", name="GNU Lesser General Public License", version="3")),
    ("LGPL-3.0", _COPYING.format(name="GNU LESSER GENERAL PUBLIC LICENSE", version="3, 29 June 2007", year="2007")),
    ("MIT", f"""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
{_NO_WARRANTY}
IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a
compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions."""),
)
