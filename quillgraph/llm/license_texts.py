"""Known licence texts and equivalent spellings (fixed values)."""

#: Pairs replaced in lower-cased texts, in this order.
EQUIVALENT = [
    ("licence", "license"),
    ("acknowledgement", "acknowledgment"),
    ("favour", "favor"),
    ("honour", "honor"),
    ("sub-license", "sublicense"),
    ("non-commercial", "noncommercial"),
    ("https://", "http://"),
    ("copyright holder", "copyright owner"),
    ("\u201c", '"'),
    ("\u201d", '"'),
]

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO '
    "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
    "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
    "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN "
    "AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
    "PERFORMANCE OF THIS SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list "
    "of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright "
    "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
    "with the distribution.\n\n"
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission.\n\n"
)
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

#: (name, text): whole licences, and the notices by which a text states its licence.
KNOWN = [
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software.\n\n" + _WARRANTY,
    ),
    (
        "MIT-0",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so.\n\n" + _WARRANTY,
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_WARRANTY,
    ),
    (
        "0BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted.\n\n" + _ISC_WARRANTY,
    ),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this "
        "software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject "
        "to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim "
        "that you wrote the original software. If you use this software in a product, an acknowledgment in the product "
        "documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as "
        "such, and must not be misrepresented as being the original software.\n\n3. This notice may not be removed or "
        "altered from any source distribution.",
    ),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
]

#: (digest, name) of whole licences whose texts are too long to state here: SHA-256 of the canonical text, for those with a line
#: "END OF TERMS AND CONDITIONS" also of the text up to that line (fixed values; they change with EQUIVALENT and ``canonical``).
DIGESTS = [
    ("ff7be961361eda3cd2a76927dd0d9482cf45defafde2045befedf77400d98100", "Apache-2.0"),
    ("e9dbf930ca0f1e090ec68da9a37b657d11bc9e43b30643455d6a96dbf73116ca", "Apache-2.0"),
    ("842d1d7843c0e8fa9d9fc60e2e1e785750f849881896afdeab8b3bcccd224479", "Artistic-1.0-Perl"),
    ("96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f", "CC0-1.0"),
    ("6a3527458ce3cfb5ade85445cd3d6acb0b358be7b39581a865ef5d3ac4f297f8", "GFDL-1.2-only"),
    ("d93999c79de6eaf027d3a8a0aadbd0f0cefce6927b1d631b03a133c865480e3f", "GFDL-1.3-only"),
    ("37f380f152339f34a15db620545eb53f0b5c7d9e6a9542aa09ed0d22f186920f", "GPL-1.0-only"),
    ("3b5b36de4a3801680b9eb44e80739b3aeb71c4bf6ca623ee5f87b2e2b03d3ed9", "GPL-1.0-only"),
    ("5147a46525fc36b30edbb3469564d4930add19b5b86c56d8d58e084575fd474a", "GPL-2.0-only"),
    ("5e9874a182b8e50f136aed39c11d5b872aaa6c94c59b0780c37559869ffd0faa", "GPL-2.0-only"),
    ("bd8a9678cc102044334826438740622a2d2bd3bcb7254d45d9ab87e1bfced4ed", "GPL-3.0-only"),
    ("502fa73c5788144cfc3b1b6c0f5f6f80fdf0eea24cd8697030ef964b7de67d2f", "GPL-3.0-only"),
    ("82b9c718a1edbbe60a4f5828e6e8c8390d714f09bfee18638761bb3f8fdff504", "LGPL-2.0-only"),
    ("c2cefe189596f86dbbdab4ca8b161c6262f8b0d574184ce87144b676eb4e7d0a", "LGPL-2.0-only"),
    ("8972cc10118fe8a142e8b2d34ba122d3a2c710126a256b6786246af9ae4cd5a6", "LGPL-2.1-only"),
    ("0948f7f91046d0736fbe4b1285c1418c43656d51b8a98c2690fd48e68a51284e", "LGPL-2.1-only"),
    ("aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be", "LGPL-3.0-only"),
    ("f77c59051c0127d677dcce7ba0d4733294974749a7b4155250912498d92767d6", "MPL-1.1"),
    ("95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9", "MPL-2.0"),
]
