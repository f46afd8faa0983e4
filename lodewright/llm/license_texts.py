"""Known licence texts and notices, as published (fixed values)."""

# Short licence texts.
TEXTS = {
    "MIT": """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
""",
    "ISC": """ISC License

Copyright <year> <owner>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
""",
    "0BSD": """BSD Zero Clause License

Copyright (C) <year> by <owner>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
""",
    "Zlib": """zlib License

Copyright (C) <year> <owner>

This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.
""",
    "BSD-2-Clause": """BSD 2-Clause License

Copyright (c) <year>, <owner>

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
""",
    "BSD-3-Clause": """BSD 3-Clause License

Copyright (c) <year>, <owner>

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>
""",
    "BSL-1.0": """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
""",
    "MIT-0": """MIT No Attribution

Copyright <year> <owner>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
""",
}

# One-line notices that name a licence.
NOTICES = {
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT"),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-only",
    ),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0"),
    "ISC": ("Released under the ISC License.", "SPDX-License-Identifier: ISC"),
}

# Digests of the canonical form of longer licence texts, as published, with and without what follows the terms.
DIGESTS = {
    "Apache-2.0": (
        "3a25ef1ea7b3c32f8435f633f2a01e239fedc21f89866084fd400d61f2fb0850",
        "3b007760ca09b0678effc9d3d74597dc31e92b682a83d10e09b6dfd8343287e0",
        "4b5828edb0ed9320212fb3c50151091c03d2da294e2a283e5d33cda1e2d9c2fd",
        "ecae8a5a0c9832e141179311b86748054a8755f17b0c2ebec9cea58f01c3abf6",
        "ecbef17d0facf0c556f1371b8918c79da58481d6cce672d8f6804ca1407f3131",
        "efe9016df00706f076eed643a31535866e1254d860aedfab78b44e99f64af894",
    ),
    "Artistic-1.0-Perl": (
        "4eaaa9e33aeef0af0ff83ab5edac0ad421a1da9cc861c564630460107b4b772c",
        "605e60098b41000a8ac1cb87343cfd8399e2ac1e421e6d7cd712adfc7e27b7bf",
    ),
    "CC0-1.0": (
        "888ab175b43ed137ae3c3f8f32a1f0e1677fe31f7a9f09890c39b11b1934ad6c",
        "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e",
    ),
    "GFDL-1.2": (
        "4469e9bda72f1290107fc02e7c5ccbdbbf94bce949b78f26684a1400b6b30a75",
        "545545286db25b2cefc94c73676cdef3be703b997bffd9c24debfaf153c4b031",
        "8c5ad7c8aabb9db6e0c8b0f17a42302bd4f1ae1e177fb7d07be8a39b24692ecb",
        "b8fc1476fcb02a8c859046708b4843944af8ef9ae2f634b9f46b5a633388f9f3",
    ),
    "GFDL-1.3": (
        "41d017996d978422cff4938f636b9e505797bf6588c053baa4c8bd94070ba8f6",
        "4535febd1992d48cf58c30b98b1b8276270248059dbb9686530fda1a11c5a4e8",
        "964db30bfaaec090ff7e3a9678ef29c7964a1812c6d2141e2b7552c0780bf413",
        "e907f46bdc7f3e8e6160d770fd1642b01fb33d2f98ef7b09c8988fbe26f79fae",
    ),
    "GPL-1.0": (
        "004d51305feee6b52152c2f281ce28deaeb53eb4a4d007ee76cd7a921214d66a",
        "56e7ac4f77f5a6fd00564e33cd7fb62a8c7208e1b5c7da3f200f9258df1337a6",
        "9132a605811c9f9a51621da0e0708f46e408e3507a3c1a9d16a5f48291082b8c",
        "b20b3400deed704ae0c50c928e65696fde43e7241653a85a10b68d5738ecc9dc",
        "ca8a13e258985f008e9e869c46b2f9ce910ff6e64682660c0130a3a2597b9056",
        "ccb759ed9f97b19013bbb75be2c230355e8b3993d435c1885559ea0b715b8cca",
    ),
    "GPL-2.0": (
        "29507662ad31f55a5ac02f26a5d8cca21add440b2dff4a9ce97e458a0ca43f7f",
        "5ef1f5f0461a54997a170af5c87102900e651106207b80558de731fd1db30832",
        "639c69262acf6777ee0c163867caf39bdb5ec90b59bad9412c9e6101fb65e404",
        "82622ece9274df820a4bf2660799088e526913044650336e5d85bb78500da8f8",
        "aa280a5f4d3c1d5204ecef8bb48e74c0b275c98788f5596001a0801dff4f5042",
        "b519669ce969d79c162f16dca67a0abab53b46986efb528afe3e105936cc0050",
    ),
    "GPL-3.0": (
        "7649ebbf3b070f38d710d6c6b656cbe1d02e00991423dedb73cb040e73d42572",
        "888dd3b6e21b31412e3e47000b49d18dbd8f52fb42ccb5fc3108c8ca3c150b16",
        "9cc451110eb36d5a5309a55664c88e014da02bb21360c77e6e32c6ada8511d9b",
        "bb78866f03c739fdcbb3ac192baffacca54ae9c880efb663694b151739f8e746",
        "bf9e206799496404ec781ceaf777966308e875445239b2a25248b6a0f817844d",
        "e625dabe077d0db98f64e03d412721706f2820142716a54a88c302e2f67ca53f",
    ),
    "LGPL-2.0": (
        "1bcddbd821db9aff439d7cd0cc29582bde4192194dead3bbf1218f38ca99554f",
        "347b0741d4d1d9edfb3ccaa592aed77e26de0fb444222e92bf5998127677fc66",
        "4658bdd6101102dff355dc896f8841f55e13624d29a7603a0910a945995144ad",
        "9c23d4ec08c96de18510022fc734a8ee0a97727299d09046fc5ce263d269352e",
        "f17ebefdba4ae01060494f3396c1bc854578b6eaafaa6fe8abcf7a94e7fc2a6e",
        "ffd8730789ab0fc5853425d608bf29d213379ce803c8549814e85648681ef32a",
    ),
    "LGPL-2.1": (
        "02d1c6765d5d7d83c080934e4f4d4e8a534db157a3addff8d581f70e285a297a",
        "0af47c8da0e16365147be761910b2af02249ed8ea2f5dbed0a027d6f7639058a",
        "1b0f2373f80527d4e0de3c4558c0b3804f46c844770e82398a9876c782f360f9",
        "50866b22e296e073a398813dc84c4c9dec94ed1ee7d617c063eb6851a562b9d4",
        "affa875b69d174bd7ff301ad69b35855f32944fe11c4350456f5a8d655d22e4a",
        "d0eb3b85d5950e57dcf723d810a4192fd293190f12de6ccbfaae7acc8c10bdd6",
    ),
    "LGPL-3.0": (
        "26aeb5d3e16e4dee74aba841e3bb744f36eef8e902c291b36439a8a02441cb95",
        "e1c7b25e9116bcad127297bbfb82e6a89822822ba6bfa3af9eae995aad877765",
    ),
    "MPL-1.1": (
        "6e3f6948b26cea964fba28b65a60b240e9e6cb9e8a5daa3ccee9715e3266a817",
        "74bca2f4c12b5259eae2cf5931d749fa8acec23b4982b2eeb446232da37c58b7",
        "93a8d1fdbe0e5aae4693453ab1b3c1237c1609cbae0db2f2983a8dcb98ae21a9",
        "f860e8704cccae980647f42bf056e16dae6677dbaa164180a8d3edea57fc61a1",
    ),
    "MPL-2.0": (
        "414421004b4d21bbc0e3e44ad778ba4b1f4c41629c0323fde324d59db3152763",
        "5366f53347cb3ac4060a93f60a5cbf0dd5f2ffa63c73c22706762666e889ea5b",
        "8f27174c93cb7f68399e5e71af858fdef9c2151b9de96b0dd9bab40a165711b3",
        "c0f855aacb6ac1c86bcdd1334db61014d14898798ae14888fea5446cbb9d32e3",
    ),
}
