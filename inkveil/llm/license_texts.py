"""Licence templates: label -> (mandatory key phrase, text). Sentences are the units that are looked for.

Fixed values: the wording of public licences and of the notices by which they are applied. A run may pass templates of its own.
"""

_WARRANTY = """
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""
_BSD_CONDITIONS = """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are
met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution.
"""
_BSD_DISCLAIMER = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
"""
_GNU_WARRANTY = """
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
"""
_ISC = """
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL
WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
"""

TEMPLATES = {
    "0bsd": (
        "for any purpose with or without fee is hereby granted the software is provided as is",
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES.',
    ),
    "agpl": (
        "affero general public license",
        """Licensed under the GNU Affero General Public License. This program is free software: you can redistribute it and/or modify it under the terms of
        the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."""
        + _GNU_WARRANTY,
    ),
    "apache-2.0": (
        "apache license version 2 0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
        obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
        See the License for the specific language governing permissions and limitations under the License.""",
    ),
    "artistic": ("artistic license", "This package is distributed under the Artistic License. You may redistribute it under the same terms as Perl itself."),
    "bsd-2": ("redistribution and use in source and binary forms", _BSD_CONDITIONS + _BSD_DISCLAIMER),
    "bsd-3": (
        "neither the name of",
        _BSD_CONDITIONS
        + "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
        + _BSD_DISCLAIMER,
    ),
    "bsd-notice": ("bsd license", "Released under the BSD License. Use of this source code is governed by a BSD license that can be found in the LICENSE file."),
    "bsl-1.0": (
        "boost software license",
        """Distributed under the Boost Software License, Version 1.0. Permission is hereby granted, free of charge, to any person or organization obtaining a
        copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software.""",
    ),
    "cc-by-nc": ("cc by nc", "Licensed under CC BY-NC 4.0. This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc-by-nd": ("cc by nd", "Licensed under CC BY-ND 4.0. This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "cc-by-sa": ("cc by sa", "Licensed under CC BY-SA 4.0. This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc-attribution": ("creative commons attribution", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc0": (
        "cc0",
        """CC0 1.0 Universal public domain dedication. To the extent possible under law, the author has waived all copyright and related or neighboring rights
        to this work under CC0.""",
    ),
    "epl": (
        "eclipse public license",
        """This program and the accompanying materials are made available under the terms of the Eclipse Public License which accompanies this distribution, and is
        available at http://www.eclipse.org/legal/epl.""",
    ),
    "gpl-2": (
        "gnu general public license version 2",
        """Licensed under the GNU General Public License, version 2. This program is free software; you can redistribute it and/or modify it under the terms of
        the GNU General Public License version 2 as published by the Free Software Foundation.""" + _GNU_WARRANTY,
    ),
    "gpl-3": (
        "gnu general public license version 3",
        """This work is licensed under the GNU General Public License, version 3. This program is free software: you can redistribute it and/or modify it under the
        terms of the GNU General Public License version 3 as published by the Free Software Foundation.""" + _GNU_WARRANTY,
    ),
    "gpl-notice": (
        "gnu general public license",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
        Foundation, either version 3 of the License, or (at your option) any later version.""" + _GNU_WARRANTY + "You should have received a copy of the GNU General Public License along with this program.",
    ),
    "isc": ("permission to use copy modify and or distribute", _ISC),
    "lgpl": (
        "lesser general public license",
        """Licensed under the GNU Lesser General Public License. This library is free software; you can redistribute it and/or modify it under the terms of the
        GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.""",
    ),
    "mit": ("mit license", "Released under the MIT License. Licensed under the MIT License."),
    "mit-text": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
        in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies
        of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
        permission notice shall be included in all copies or substantial portions of the Software.""" + _WARRANTY,
    ),
    "mpl": (
        "mozilla public license",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can
        obtain one at http://mozilla.org/MPL/2.0/.""",
    ),
    "postgresql": (
        "permission to use copy modify and distribute this software and its documentation",
        """Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby
        granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.""",
    ),
    "unlicense": (
        "unencumbered software released into the public domain",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this
        software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize
        copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.""",
    ),
    "wtfpl": ("do what the fuck you want to public license", "Do What The Fuck You Want To Public License. Everyone is permitted to copy and distribute verbatim or modified copies of this license document."),
    "zlib": (
        "provided as is without any express or implied warranty",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use
        of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it
        freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software.
        Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed
        or altered from any source distribution.""",
    ),
}
