"""License wording as template markup: whole texts of short licenses, standard notices of long ones. Case and punctuation don't count.

<<optional>> ... <</optional>> may be left out, <<any:n>> stands for up to n words. All other words are mandatory.
"""

# The wording of the licenses.

_GRANT = """Permission is hereby granted, free of charge, to any person <<optional>> or organization <</optional>> obtaining a copy of this software and
    associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
    publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"""

_MIT_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
    FITNESS FOR A PARTICULAR PURPOSE AND <<optional>> NONINFRINGEMENT <</optional>> <<optional>> NON-INFRINGEMENT <</optional>>. IN NO EVENT SHALL <<any:10>> BE LIABLE FOR ANY CLAIM,
    DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_ISC_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS" AND <<any:10>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
    AND FITNESS. IN NO EVENT SHALL <<any:10>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE,
    DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

_BSD_TWO = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
    <<any:1>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
    <<any:1>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
    materials provided with the distribution."""

_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY <<any:10>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
    MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<any:10>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
    CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED
    AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN
    IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_COPYRIGHT = "<<optional>> Copyright <<any:20>> <</optional>> <<optional>> All rights reserved. <</optional>>"

_FREE_SOFTWARE = """<<optional>> This program is <</optional>> <<optional>> <<any:4>> is <</optional>> free software <<any:1>> you can redistribute it and/or modify it under the terms of the GNU"""

_PUBLISHED = "as published by the Free Software Foundation"

_LATER = "<<optional>> of the License <</optional>> <<optional>> or (at your option) any later version <</optional>>"

#: label -> markup
TEMPLATES = {
    "mit": f"""<<optional>> <<optional>> The <</optional>> MIT License <<optional>> (MIT) <</optional>> <</optional>> {_COPYRIGHT} {_GRANT}, subject to the following conditions:
        The above copyright notice and this permission notice <<optional>> (including the next paragraph) <</optional>> shall be included in all copies or substantial portions of the
        Software. {_MIT_DISCLAIMER}""",
    "mit-0": f"<<optional>> MIT No Attribution <</optional>> {_COPYRIGHT} {_GRANT}. {_MIT_DISCLAIMER}",
    "x11": f"""<<optional>> X11 License <</optional>> {_COPYRIGHT} {_GRANT}, subject to the following conditions: The above copyright notice and this permission notice shall be
        included in all copies or substantial portions of the Software. {_MIT_DISCLAIMER} Except as contained in this notice, the name of <<any:10>> shall not be used in
        advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from <<any:10>>""",
    "isc": f"""<<optional>> ISC License <</optional>> {_COPYRIGHT} Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_DISCLAIMER}""",
    "0bsd": f"""<<optional>> Zero-Clause BSD <</optional>> {_COPYRIGHT} Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted. {_ISC_DISCLAIMER}""",
    "bsd-2-clause": f"<<optional>> BSD 2-Clause License <</optional>> {_COPYRIGHT} {_BSD_TWO} {_BSD_DISCLAIMER}",
    "bsd-3-clause": f"""<<optional>> BSD 3-Clause License <</optional>> {_COPYRIGHT} {_BSD_TWO} <<any:1>> Neither the name of <<any:15>> nor the names of <<any:6>> contributors may be used
        to endorse or promote products derived from this software without specific prior written permission. {_BSD_DISCLAIMER}""",
    "zlib": f"""<<optional>> zlib License <</optional>> {_COPYRIGHT} This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to
        alter it and redistribute it freely, subject to the following restrictions: <<any:1>> The origin of this software must not be misrepresented; you must not claim that you wrote
        the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. <<any:1>> Altered source
        versions must be plainly marked as such, and must not be misrepresented as being the original software. <<any:1>> This notice may not be removed or altered from any source
        distribution.""",
    "bsl-1.0": """<<optional>> Boost Software License - Version 1.0 - August 17th, 2003 <</optional>> Permission is hereby granted, free of charge, to any person or organization obtaining
        a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to
        prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the
        Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or
        in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language
        processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
        PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER
        IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software,
        either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or
        authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the
        detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under
        copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
        PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
        ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "wtfpl": """DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE <<any:40>> Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is
        allowed as long as the name is changed. <<any:14>> TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO.""",
    "postgresql": """Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted,
        provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies. IN NO EVENT SHALL <<any:10>> BE LIABLE TO ANY PARTY FOR DIRECT,
        INDIRECT, SPECIAL, INCIDENTAL, OR CONSEQUENTIAL DAMAGES, INCLUDING LOST PROFITS, ARISING OUT OF THE USE OF THIS SOFTWARE AND ITS DOCUMENTATION, EVEN IF <<any:10>> HAS BEEN ADVISED
        OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "apache-2.0": """<<optional>> Licensed under the Apache License, Version 2.0 (the "License"); <</optional>> you may not use this <<any:3>> except in compliance with the License. You may
        obtain a copy of the License at <<optional>> http <<any:1>> www.apache.org/licenses/LICENSE-2.0 <</optional>> <<any:2>> Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
        specific language governing permissions and limitations under the License.""",
    "gpl-2.0": f"{_FREE_SOFTWARE} General Public License {_PUBLISHED} <<any:1>> <<optional>> either <</optional>> version 2 {_LATER}",
    "gpl-3.0": f"{_FREE_SOFTWARE} General Public License {_PUBLISHED} <<any:1>> <<optional>> either <</optional>> version 3 {_LATER}",
    "lgpl-2.1": f"{_FREE_SOFTWARE} Lesser General Public License {_PUBLISHED} <<any:1>> <<optional>> either <</optional>> version 2.1 {_LATER}",
    "lgpl-3.0": f"{_FREE_SOFTWARE} Lesser General Public License {_PUBLISHED} <<any:1>> <<optional>> either <</optional>> version 3 {_LATER}",
    "agpl-3.0": f"{_FREE_SOFTWARE} Affero General Public License {_PUBLISHED} <<any:1>> <<optional>> either <</optional>> version 3 {_LATER}",
    "mpl-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
        http <<optional>> s <</optional>> <<any:1>> mozilla.org/MPL/2.0""",
    "epl-2.0": """This program and the accompanying materials are made available under the terms of the Eclipse Public License <<any:1>> 2.0 which <<any:2>> available at""",
    "cc-by-4.0": """<<optional>> This work is <</optional>> licensed under <<any:2>> Creative Commons Attribution 4.0 International <<optional>> Public <</optional>> License""",
    "cc-by-sa-4.0": """<<optional>> This work is <</optional>> licensed under <<any:2>> Creative Commons Attribution ShareAlike 4.0 International <<optional>> Public <</optional>> License""",
    "cc0-1.0": """<<optional>> To the extent possible under law <<any:20>> has <</optional>> waived all copyright and related or neighboring rights to""",
    # notices of one sentence
    "gpl-3": """licensed under <<optional>> the terms of <</optional>> the GNU General Public License <<optional>> as published by the Free Software Foundation <<optional>> either <</optional>>
        <</optional>> version 3""",
    "cc-by-nc-4.0": "licensed under <<optional>> a <</optional>> <<optional>> the <</optional>> <<optional>> Creative Commons <<any:3>> <</optional>> CC BY-NC 4.0",
}
