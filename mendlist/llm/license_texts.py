"""Customary notices, file headers, titles, SPDX tags and texts of common licenses."""

#: SPDX identifiers whose tags are recognised, and the license that each names.
IDENTIFIERS = """
0BSD AGPL-3.0 Apache-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC0-1.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-SA-4.0 EPL-2.0
GPL-2.0 GPL-3.0 ISC LGPL-2.1 LGPL-3.0 MIT MPL-2.0 Unlicense Zlib
""".split()

#: GNU licenses have two more tags each.
GNU_FORMS = ("-only", "-or-later")

NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This work is licensed under the Mozilla Public License, version 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("ISC", "Released under the ISC License."),
    ("Unlicense", "Released into the public domain under the Unlicense."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("Zlib", "Released under the zlib license."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MIT", "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file."),
]

#: Names that notices of projects and packages use.
_NAMES = [
    ("Apache-2.0", "Apache License 2.0"), ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"),
    ("GPL-2.0", "GNU GPL v2"), ("GPL-3.0", "GNU GPL v3"), ("LGPL-3.0", "GNU LGPL v3"), ("AGPL-3.0", "GNU AGPL v3"),
    ("ISC", "ISC License"), ("MIT", "MIT License"), ("MPL-2.0", "Mozilla Public License 2.0"),
]
NOTICES += [(key, f"This project is licensed under the terms of the {name}.") for key, name in _NAMES]

TITLES = [
    ("MIT", "MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("ISC", "ISC License"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
]

_GNU_FREE = (
    "{program} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} "
    "as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version."
)
_GNU_REST = (
    " {program} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should have received a copy "
    "of the GNU {name} along with this program. If not, see <https://www.gnu.org/licenses/>."
)
_GNU = [
    ("GPL-2.0", "This program", "General Public License", "2"),
    ("GPL-3.0", "This program", "General Public License", "3"),
    ("LGPL-2.1", "This library", "Lesser General Public License", "2.1"),
    ("LGPL-3.0", "This library", "Lesser General Public License", "3"),
    ("AGPL-3.0", "This program", "Affero General Public License", "3"),
]

HEADERS = [
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
        'law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT '
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    (
        "BSL-1.0",
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at "
        "https://www.boost.org/LICENSE_1_0.txt)",
    ),
    *[(key, _GNU_FREE.format(program=p, name=n, version=v)) for key, p, n, v in _GNU],
    *[(key, (_GNU_FREE + _GNU_REST).format(program=p, name=n, version=v)) for key, p, n, v in _GNU],
]

_BSD_TWO = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions "
    "and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_NAME = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission. "
)
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR "
    "CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR "
    "PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR "
    "TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
    "POSSIBILITY OF SUCH DAMAGE."
)

#: Whole texts of the short licenses, and the opening of the long ones.
TEXTS = [
    (
        "MIT",
        "MIT License Copyright (c) Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
        "this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
        "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "ISC License Copyright (c) Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
        "fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
        "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
        "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("BSD-2-Clause", "Copyright (c) All rights reserved. " + _BSD_TWO + _BSD_WARRANTY),
    ("BSD-3-Clause", "Copyright (c) All rights reserved. " + _BSD_TWO + _BSD_NAME + _BSD_WARRANTY),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for "
        "any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, "
        "including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. "
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use "
        "this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. "
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. "
        "This notice may not be removed or altered from any source distribution.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial "
        "or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software "
        "dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of "
        "the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of "
        "relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    ),
    (
        "Apache-2.0",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND "
        'DISTRIBUTION 1. Definitions. "License" shall mean the terms and conditions for use, reproduction, and distribution as '
        'defined by Sections 1 through 9 of this document. "Licensor" shall mean the copyright owner or entity authorized by the '
        'copyright owner that is granting the License. "Legal Entity" shall mean the union of the acting entity and all other '
        'entities that control, are controlled by, or are under common control with that entity. "You" (or "Your") shall mean an '
        'individual or Legal Entity exercising permissions granted by this License. "Source" form shall mean the preferred form for '
        'making modifications, including but not limited to software source code. "Object" form shall mean any form resulting from '
        'mechanical transformation or translation of a Source form. "Work" shall mean the work of authorship, whether in Source or '
        'Object form, made available under the License. "Derivative Works" shall mean any work that is based on the Work. '
        '"Contribution" shall mean any work of authorship that is intentionally submitted to Licensor for inclusion in the Work. '
        '"Contributor" shall mean Licensor and any individual or Legal Entity on behalf of whom a Contribution has been received by '
        "Licensor. 2. Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants "
        "to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare "
        "Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works. 3. "
        "Grant of Patent License. 4. Redistribution. You may reproduce and distribute copies of the Work or Derivative Works thereof "
        "in any medium, with or without modifications, and in Source or Object form.",
    ),
    (
        "GPL-2.0",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 The licenses for most software are designed to take away your freedom to "
        "share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change "
        "free software. This License applies to any program or other work which contains a notice placed by the copyright holder "
        'saying it may be distributed under the terms of this General Public License. The "Program", below, refers to any such '
        'program or work, and a "work based on the Program" means either the Program or any derivative work under copyright law. '
        "You may copy and distribute verbatim copies of the Program's source code as you receive it, in any medium, provided that "
        "you conspicuously and appropriately publish on each copy an appropriate copyright notice and disclaimer of warranty; keep "
        "intact all the notices that refer to this License and to the absence of any warranty; and give any other recipients of the "
        "Program a copy of this License along with the Program. You may modify your copy or copies of the Program or any portion of "
        "it, thus forming a work based on the Program, and copy and distribute such modifications or work under the terms of Section "
        "1 above. You may copy and distribute the Program in object code or executable form. You are not required to accept this "
        "License, since you have not signed it. BECAUSE THE PROGRAM IS LICENSED FREE OF CHARGE, THERE IS NO WARRANTY FOR THE PROGRAM.",
    ),
    (
        "GPL-3.0",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 The GNU General Public License is a free, copyleft license for software "
        'and other kinds of works. "This License" refers to version 3 of the GNU General Public License. "The Program" refers to any '
        'copyrightable work licensed under this License. Each licensee is addressed as "you". To "modify" a work means to copy from '
        "or adapt all or part of the work in a fashion requiring copyright permission. A \"covered work\" means either the unmodified "
        'Program or a work based on the Program. To "propagate" a work means to do anything with it that would make you liable. To '
        '"convey" a work means any kind of propagation that enables other parties to make or receive copies. The "source code" for a '
        "work means the preferred form of the work for making modifications to it. The \"Corresponding Source\" for a work in object "
        "code form means all the source code needed to generate, install, and run the object code. You may convey a covered work in "
        "object code form under the terms of this License, provided that you also convey the machine-readable Corresponding Source. "
        'A "User Product" is either a consumer product or anything designed for incorporation into a dwelling. "Installation '
        'Information" for a User Product means any methods, procedures, authorization keys. Each time you convey a covered work, the '
        "recipient automatically receives a license from the original licensors, to run, modify and propagate that work, subject to "
        "this License. A contributor's essential patent claims are all patent claims owned or controlled by the contributor.",
    ),
    (
        "LGPL-2.1",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 This license, the Lesser General Public License, applies to some "
        "specially designated software packages, typically libraries, of the Free Software Foundation and other authors who decide to "
        'use it. A "library" means a collection of software functions and/or data prepared so as to be conveniently linked with '
        'application programs to form executables. The "Library", below, refers to any such software library or work which has been '
        'distributed under these terms. A "work based on the Library" means either the Library or any derivative work under '
        "copyright law. You may modify your copy or copies of the Library or any portion of it. A program that contains no "
        "derivative of any portion of the Library, but is designed to work with the Library by being compiled or linked with it, is "
        'called a "work that uses the Library". The object code for the work may be linked with the Library.',
    ),
    (
        "LGPL-3.0",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 This version of the GNU Lesser General Public License incorporates "
        "the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed "
        'below. "The Library" refers to a covered work governed by this License, other than an Application or a Combined Work. An '
        '"Application" is any work that makes use of an interface provided by the Library, but which is not otherwise based on the '
        'Library. A "Combined Work" is a work produced by combining or linking an Application with the Library. The particular '
        'version of the Library with which the Combined Work was made is also called the "Linked Version". You may convey a covered '
        "work under sections 3 and 4 of this License without being bound by section 3 of the GNU GPL. You may convey a Combined Work "
        "under terms of your choice that do not restrict modification of the portions of the Library contained in the Combined Work.",
    ),
    (
        "MPL-2.0",
        'Mozilla Public License Version 2.0 1. Definitions 1.1. "Contributor" means each individual or legal entity that creates, '
        'contributes to the creation of, or owns Covered Software. 1.2. "Contributor Version" means the combination of the '
        "Contributions of others (if any) used by a Contributor and that particular Contributor's Contribution. 1.4. \"Covered "
        'Software" means Source Code Form to which the initial Contributor has attached the notice in Exhibit A, the Executable Form '
        "of such Source Code Form, and Modifications of such Source Code Form, in each case including portions thereof. "
        '"Incompatible With Secondary Licenses". "Larger Work" means a work that combines Covered Software with other material, in a '
        'separate file or files, that is not Covered Software. "Secondary License". 2. License Grants and Conditions. Each '
        "Contributor hereby grants You a world-wide, royalty-free, non-exclusive license. 3. Responsibilities. All distribution of "
        "Covered Software in Source Code Form, including any Modifications that You create or to which You contribute, must be under "
        "the terms of this License. You may distribute such Executable Form under the terms of this License.",
    ),
]


def templates() -> list[tuple[str, str]]:
    """(license, text) of all forms: first ``FILE_FORMS`` that may be a whole file, then those of headers alone."""
    gnu = [i for i in IDENTIFIERS if "GPL" in i]
    tags = [(i, f"SPDX-License-Identifier: {i}") for i in IDENTIFIERS]
    tags += [(i, f"SPDX-License-Identifier: {i}{form}") for i in gnu for form in GNU_FORMS]
    return NOTICES + TITLES + TEXTS + HEADERS + tags


FILE_FORMS = len(NOTICES + TITLES + TEXTS)
