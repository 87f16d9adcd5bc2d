"""License scans by canonical digest: texts and notice lines are normalised, digested and joined to known licences.

DataFrame functions only.
"""

from pyspark.sql import functions as F

#: Texts and notices that the SQL knows, by SPDX identifier. The scan knows those of ``known_texts`` too.
NOTICES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE '
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
        "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF "
        "USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
        "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "MIT",
        "MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
        'and associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies "
        'or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, '
        "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
        "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
]

_MIT = dict(NOTICES[-1:])["MIT"].removeprefix("MIT License ")
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:"
)
_BSD_ITEMS = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
    "disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
    "following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission.",
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
    "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY "
    "OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC_END = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER "
    "IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
    "PERFORMANCE OF THIS SOFTWARE."
)
_ISC = "Permission to use, copy, modify, and{} distribute this software for any purpose with or without fee is hereby granted"
_GIVEN = ", provided that the above copyright notice and this permission notice appear in all copies. "


def _bsd(items):
    """With list items unmarked, numbered or starred, and the two spellings of the holder in the disclaimer."""
    for mark in ("", "{}. ", "({}) "):
        body = " ".join([_BSD] + [mark.format(i + 1) + item for i, item in enumerate(items)])
        for end in (_BSD_END, _BSD_END.replace("COPYRIGHT HOLDER OR", "COPYRIGHT OWNER OR")):
            for name in ("the copyright holder", "the copyright holders", "the author", "the project", "the organization"):
                yield f"{body} {end}".replace("the copyright holder nor", f"{name} nor")


#: Whole texts by identifier: titles that may stand above, and bodies.
WHOLE = {
    "MIT": (["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"], [_MIT]),
    "MIT-0": (
        ["MIT No Attribution", "MIT-0", "MIT No Attribution License"],
        [_MIT.replace(", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", ".").replace(" so, subject to the following conditions:", " so.")],
    ),
    "ISC": (
        ["ISC License", "The ISC License", "ISC License (ISC)"],
        [_ISC.format(either) + _GIVEN + _ISC_END for either in ("/or", "")],
    ),
    "0BSD": (
        ["BSD Zero Clause License", "Zero-Clause BSD", "BSD Zero Clause License (0BSD)", "0BSD"],
        [_ISC.format("/or") + ". " + _ISC_END],
    ),
    "BSD-2-Clause": (
        ["BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "The 2-Clause BSD License"],
        [*_bsd(_BSD_ITEMS[:2])],
    ),
    "BSD-3-Clause": (
        ["BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "The 3-Clause BSD License", "BSD License"],
        [*_bsd(_BSD_ITEMS)],
    ),
    "Zlib": (
        ["zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"],
        [
            "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be "
            "held liable for any damages arising from the use of this software. Permission is granted to anyone to use "
            "this software for any purpose, including commercial applications, and to alter it and redistribute it "
            f"freely, subject to the following restrictions: {a} The origin of this software must not be misrepresented; "
            "you must not claim that you wrote the original software. If you use this software in a product, an "
            f"acknowledgment in the product documentation would be appreciated but is not required. {b} Altered source "
            "versions must be plainly marked as such, and must not be misrepresented as being the original software. "
            f"{c} This notice may not be removed or altered from any source distribution."
            for a, b, c in (("1.", "2.", "3."), ("", "", ""))
        ],
    ),
    "Unlicense": (
        ["The Unlicense", "Unlicense"],
        [
            "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
            "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
            "binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize "
            "copyright laws, the author or authors of this software dedicate any and all copyright interest in the "
            "software to the public domain. We make this dedication for the benefit of the public at large and to the "
            "detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in "
            "perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "
            '"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
            "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE "
            "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
            "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
            + more
            for more in ("", " For more information, please refer to <https://unlicense.org>", " For more information, please refer to <https://unlicense.org/>")
        ],
    ),
}

#: Digests of long texts in their canonical form, as Debian's base-files has them.
LONG = {
    "04e64e0427d80fdde16fa8415931bf2c09bc943f13ec322a09df188bf23a3543": "Apache-2.0",
    "824065d72ca31b7c727341396be4cf76f464b15d9bef680a3638007ce92a009f": "Apache-2.0",
    "119e2da0e9ec849d113a40405b338c1bbbd2ef9194c22bf2740fa4e195411c40": "Apache-2.0",
    "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f": "CC0-1.0",
    "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224": "GPL-1.0-only",
    "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70": "GPL-1.0-only",
    "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc": "GPL-1.0-only",
    "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821": "GPL-2.0-only",
    "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808": "GPL-2.0-only",
    "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34": "GPL-2.0-only",
    "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a": "GPL-3.0-only",
    "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191": "GPL-3.0-only",
    "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636": "GPL-3.0-only",
    "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908": "LGPL-2.0-only",
    "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2": "LGPL-2.0-only",
    "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260": "LGPL-2.0-only",
    "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891": "LGPL-2.1-only",
    "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df": "LGPL-2.1-only",
    "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4": "LGPL-2.1-only",
    "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be": "LGPL-3.0-only",
    "63bed425f664c96ae38cce61a56cbc66b69b299ec720b59f0f79eca7b324c2b2": "MPL-1.1",
    "6fedd8db6adb0e102fc0f69b9e1501d2edaf25940e34910831cab46f9f5d4e4d": "MPL-2.0",
    "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60": "GFDL-1.2-only",
    "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826": "GFDL-1.3-only",
    "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2": "Artistic-1.0-Perl",
}

#: Names by which notices call a licence, without 'the', by identifier.
NAMES = {
    "MIT": ["MIT License", "MIT", "MIT License (MIT)"],
    "MIT-0": ["MIT No Attribution License", "MIT-0 License", "MIT-0"],
    "ISC": ["ISC License", "ISC"],
    "0BSD": ["BSD Zero Clause License", "0BSD License", "0BSD"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "BSD-2-Clause", 'BSD 2-Clause "Simplified" License'],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License", "Revised BSD License", "BSD-3-Clause", 'BSD 3-Clause "New" or "Revised" License'],
    "Zlib": ["zlib License", "zlib/libpng License", "zlib"],
    "Unlicense": ["Unlicense"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache 2.0", "Apache License, Version 2.0 (Apache-2.0)", "Apache Software License, Version 2.0"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0", "MPL-2.0 License"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 License", "CC0 1.0 Universal", "CC0 1.0 Universal License", "CC0"],
}
for _kind, _long in (("BY", ""), ("BY-SA", "-ShareAlike"), ("BY-NC", "-NonCommercial"), ("BY-ND", "-NoDerivatives"), ("BY-NC-SA", "-NonCommercial-ShareAlike"), ("BY-NC-ND", "-NonCommercial-NoDerivatives")):
    NAMES[f"CC-{_kind}-4.0"] = [f"CC {_kind} 4.0", f"CC {_kind} 4.0 License"] + [
        f"Creative Commons Attribution{_long} 4.0{_rest}" for _rest in ("", " License", " International", " International License", " International Public License")
    ]
for _short, _name, _versions in (
    ("GPL", "GNU General Public License", ("2.0", "3.0")),
    ("LGPL", "GNU Lesser General Public License", ("2.1", "3.0")),
    ("AGPL", "GNU Affero General Public License", ("3.0",)),
):
    for _full in _versions:
        for _kind, _ends in (("only", ("", " only")), ("or-later", (" or later", " or any later version", " or (at your option) any later version"))):
            NAMES[f"{_short}-{_full}-{_kind}"] = [
                f"{_start} {_number}{_end}"
                for _number in dict.fromkeys((_full, _full.removesuffix(".0")))
                for _start in (f"{_name}, version", f"{_name}", f"{_name} ({_short}) version", f"GNU {_short} version", f"GNU {_short}", f"{_short} version", _short)
                for _end in _ends
            ]
            NAMES[f"{_short}-{_full}-{_kind}"] += [
                f"{_gnu}{_short}v{_full.removesuffix('.0')}{_end}" for _gnu in ("", "GNU ") for _end in (*_ends, "+")[: 2 + 2 * (_kind == "or-later")]
            ]

#: How a notice may begin, in canonical form; all of them read as 'licensed under'.
LEAD = (
    r"^(?:(?:this|the|all|our) (?:[a-z]+ ){1,2}(?:is|are) |it is )?"
    r"(?:licensed|released|distributed|available|made available|published|provided) under (?:the )?"
    r"(?:terms (?:and conditions )?of )?(?:the )?"
)


def known_texts():
    """(license, text) of all whole texts and notices that the scan knows without a table of the caller's own."""
    out = list(NOTICES)
    for name, (titles, bodies) in WHOLE.items():
        out += [(name, f"{title} {body}") for title in ["", *titles] for body in bodies]
    for name, called in NAMES.items():
        out += [(name, f"SPDX-License-Identifier: {name}")] + [(name, f"Licensed under the {x}.") for x in called]
    return out


#: Spellings that mean the same, after lower-casing. Applied in this order, in Spark and in SQL.
SPELLINGS = [
    (r"licen[cs]ed", "licensed"),
    (r"licen[cs]e", "license"),
    (r"sub-license", "sublicense"),
    (r"non-infringement|non infringement", "noninfringement"),
    (r"merchantibility", "merchantability"),
    (r"authorised", "authorized"),
    (r"organisation", "organization"),
    (r"favour", "favor"),
    (r"copyright owner", "copyright holder"),
    (r"https:", "http:"),
    (r"\bv([0-9])", "version \\1"),
    (r"&", " and "),
]

#: Lines that only name a holder, as the SQL reads them: it has no lookaround and takes all lines that begin so.
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(copyright|\(c\)|©)[^\n]*$|(?m)^[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*$"
#: What makes a line name a holder: a sign, a year or its placeholder, or little more than a name. Licence texts have
#: lines that begin with the same words; what follows the word in those does not begin a name.
_YEAR = r"[\[<{(]?(?:(?:19|20)[0-9]{2}\b|(?:years?|yyyy|dates?)[\]>})])"
_NO_NAME = (
    r"(?![ \t]*(?:[,.;)\-]|(?:notices?|holders?|owners?|licen[cs]e[sd]?|laws?|and|or|in|is|as|to|on|of|for|if|its?|any|all"
    r"|an?|no|such|you|your|under|with|that|this|statements?|treat(?:y|ies)|interests?|permissions?|claims?|protection"
    r"|infringement|disclaimer|material|rights?|the (?:software|program|work|library|licen[cs]e))\b))"
)
_HOLDER = (
    r"(?:©|(?:copyright[ \t:]*)?\(c\)[ \t:]*(?:copyright\b|by\b|" + _YEAR + r")"
    r"|copyright[ \t:]*(?:©|\(c\)|by\b|" + _YEAR + r")"
    r"|copyright\b" + _NO_NAME + r"(?=[^\n]{0,80}\b(?:19|20)[0-9]{2}\b|(?:[ \t:]+[^ \t\n]+){1,6}[ \t]*$)"
    r"|\(c\)" + _NO_NAME + r"(?=(?:[ \t]+[^ \t\n]+){1,4}[ \t]*$))"
)
#: Where licence text goes on in the line of a holder: a sentence with a word of licences, or a usual beginning.
_GOES_ON = (
    r"(?<=[.!?;])[ \t]+[^.!?;\n]*\b(?:licen[cs]|permission|redistribut|spdx)"
    r"|[ \t]+(?:permission is hereby granted|permission to use|redistribution and use|(?:licen[cs]ed|released|distributed)"
    r" under|this software is provided|this program is free software|spdx-licen[cs]e)"
)
#: What only names a holder.
HOLDER_LINE = (
    r"(?m)^[^a-z0-9\n]*" + _HOLDER + r"[^\n]*?(?=$|" + _GOES_ON + r")|^[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*$"
)
#: Words by which a line is taken for a notice.
NOTICE = r"licen[cs]e"


def _replaced(value, pattern, by):
    return F.regexp_replace(value, pattern, by.replace("\\1", "$1"))


def canonical(value):
    """A text without case, copyright lines, spelling variants and punctuation.

    A line that begins with its copyright note and goes on with licence text loses the note only.
    """
    value = F.regexp_replace(F.lower(value), r"\r\n?", "\n")
    value = F.regexp_replace(value, HOLDER_LINE, " ")
    for pattern, by in SPELLINGS:
        value = _replaced(value, pattern, by)
    return F.trim(F.regexp_replace(value, r"[\x00-\x2F\x3A-\x60\x7B-\x7F‘’“”–—]+", " "))


def digest(value):
    return F.sha2(canonical(value), 256)


def _key(value, own):
    """Digest by which texts and lines are looked up: without the variants of a notice's beginning, unless the known
    texts are the caller's ``own``."""
    value = canonical(value)
    return F.sha2(value if own else F.regexp_replace(value, LEAD, "licensed under "), 256)


def known_digests(spark, licenses=None):
    """Digests of known texts: (license, text) rows of ``licenses``, or the texts, notices and digests of this module."""
    own = licenses is not None
    rows = licenses if own else spark.createDataFrame(known_texts(), "license string, text string")
    rows = rows.where("license is not null and text is not null")
    known = rows.select("license", _key(F.col("text"), own).alias("digest"), canonical(F.col("text")).alias("canonical"))
    known = known.where("canonical <> ''").select("license", "digest")
    if not own:
        known = known.union(spark.createDataFrame([(v, k) for k, v in LONG.items()], "license string, digest string"))
    # texts that differ only in what the normal form drops are one; the first name by spelling stands for them
    return known.groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs, licenses=None):
    """``docs`` with digest (of the whole normalised text), license (of the licence that the text as a whole is, or
    null), n_notices (lines that name a licence) and notices (sorted licences whose notice is a whole line of it).

    The whole text is joined to the known digests by hash; equal texts, however many, are spread by the join. Lines
    are looked up one by one in the same table, and only those with the word for licence in them. A null text has no
    digest and no notices; a text without letters or digits has the digest of the empty text and no licence. Rows and
    columns of ``docs`` stay, repeated rows too; columns with the new names are replaced.
    """
    added = ("digest", "license", "n_notices", "notices")
    kept = [c for c in docs.columns if c.lower() not in added]
    known = known_digests(docs.sparkSession, licenses)
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), r"\r\n?|\n"), lambda line: line.rlike("(?i)" + NOTICE))
    own = licenses is not None
    read = docs.select(*kept, digest(F.col("text")).alias("digest"), _key(F.col("text"), own).alias("_known"), lines.alias("_lines"))
    whole = read.join(known.withColumnRenamed("digest", "_known"), "_known", "left")
    table = known.agg(F.map_from_entries(F.collect_list(F.struct("digest", "license")))).first()[0] or {}
    by_digest = F.create_map(*[F.lit(v) for entry in sorted(table.items()) for v in entry]) if table else None
    if by_digest is None:
        named = F.array().cast("array<string>")
    else:
        found = F.transform("_lines", lambda line: F.try_element_at(by_digest, _key(line, own)))
        named = F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull())))
    return whole.select(
        *kept,
        "digest",
        "license",
        F.size("_lines").cast("long").alias("n_notices"),
        F.array_join(named, ",").alias("notices"),
    )


def scan_sql(table="documents"):
    """The same scan in SQL."""

    def quoted(value):
        return "'" + value.replace("'", "''") + "'"

    def canonical_sql(value):
        value = f"regexp_replace(lower({value}), '\\r\\n?', chr(10), 'g')"
        value = f"regexp_replace({value}, {quoted(COPYRIGHT_LINE)}, ' ', 'g')"
        for pattern, by in SPELLINGS:
            value = f"regexp_replace({value}, {quoted(pattern)}, {quoted(by)}, 'g')"
        return f"trim(regexp_replace({value}, {quoted('[' + chr(92) + 'x00-' + chr(92) + 'x2F' + chr(92) + 'x3A-' + chr(92) + 'x60' + chr(92) + 'x7B-' + chr(92) + 'x7F‘’“”–—]+')}, ' ', 'g'))"

    rows = ", ".join(f"({quoted(name)}, {quoted(text)})" for name, text in NOTICES)
    return f"""
WITH listed(license, text) AS (VALUES {rows}),
known AS (
    SELECT sha256({canonical_sql("text")}) AS digest, min(license) AS license
    FROM listed WHERE {canonical_sql("text")} <> '' GROUP BY 1
),
whole AS (SELECT doc_id, text, sha256({canonical_sql("text")}) AS digest FROM {table}),
lines AS (
    SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '\\r\\n?|\\n')) AS line FROM {table}
),
named AS (
    SELECT l.doc_id, count(*) AS n_notices, string_agg(DISTINCT k.license, ',' ORDER BY k.license) AS notices
    FROM lines l LEFT JOIN known k ON k.digest = sha256({canonical_sql("l.line")})
    WHERE regexp_matches(l.line, '(?i){NOTICE}') GROUP BY 1
)
SELECT w.doc_id, w.digest, k.license, coalesce(n.n_notices, 0) AS n_notices, coalesce(n.notices, '') AS notices
FROM whole w LEFT JOIN known k USING (digest) LEFT JOIN named n ON n.doc_id = w.doc_id
"""
