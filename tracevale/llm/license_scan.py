"""License scans by canonical digests.

A text is put in a canonical form: A-Z lower-cased, copyright lines left out, punctuation turned into spaces, equivalent
spellings made one, and spaces collapsed. The SHA-256 of the whole form is then looked up among the digests of known
licences, each in its usual forms: titles, appendices, addresses and line breaks. Each line is looked up the same way
among known notices. The known digests are a table of fixed size.

Defined cases: null and empty texts, and texts that are all copyright lines, have an empty form and no licence; repeated
rows are each looked up. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import re
import textwrap
from functools import lru_cache
from importlib import resources
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import LOWER, UPPER, ascii_lower

COPYRIGHT = r"(?m)^[ \t]*(?:copyright|\(c\)|©)[^\n]*$"
#: Spellings that count as equal, by the matching guidelines for licence texts.
EQUAL = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization", "authorised": "authorized",
    "cancelled": "canceled", "catalogue": "catalog", "categorise": "categorize", "centre": "center", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill",
    "honour": "honor", "initialise": "initialize", "judgement": "judgment", "labelling": "labeling", "labour": "labor", "licence": "license", "licenced": "licensed",
    "modelling": "modeling", "noninfringement": "non infringement", "offence": "offense", "optimise": "optimize",
    "organisation": "organization", "organise": "organize", "practise": "practice", "programme": "program", "realise": "realize", "recognise": "recognize",
    "signalling": "signaling", "sublicence": "sublicense", "utilisation": "utilization", "whilst": "while", "wilful": "willful",
}
SPELLING = [(rf"\b{a}\b", b) for a, b in EQUAL.items()]
ANY_SPELLING = re.compile(r"\b(?:" + "|".join(EQUAL) + r")\b", re.A)

#: Short licences in full.
_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_AUTHOR = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
TEXTS = {
    "MIT": """MIT License
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": f"ISC License\n{_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n{_AUTHOR}",
    "0BSD": f"{_GRANT}.\n{_AUTHOR}",
    "BSD-2-Clause": _BSD + _BSD_END,
    "BSD-3-Clause": _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n" + _BSD_END,
}
SHORT_LINES = frozenset(TEXTS)  # a line of these is a paragraph
#: Longer licences in full, in files named by licence.
TEXTS |= {f.name.removesuffix(".txt"): f.read_text(encoding="utf-8") for f in sorted(resources.files(__package__).joinpath("licenses").iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")}
#: What may stand in the place of a licence's first lines. The first are those of its text in TEXTS.
_BSD_TITLES = {n: ["", "All rights reserved.", *(f"{t}{r}" for t in (f"BSD {n}-Clause License", f'BSD {n}-Clause "{w}" License', f"The BSD {n}-Clause License", f"{w} BSD License", "BSD License") for r in ("", "\nAll rights reserved."))] for n, w in ((2, "Simplified"), (3, "New"))}
TITLES = {
    "MIT": ["MIT License", "", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "Expat License"],
    "ISC": ["ISC License", "", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)"],
    "0BSD": ["", "BSD Zero Clause License", "Zero-Clause BSD", "BSD Zero Clause License (0BSD)", "0BSD"],
    "BSD-2-Clause": _BSD_TITLES[2], "BSD-3-Clause": [*_BSD_TITLES[3], 'BSD 3-Clause "New" or "Revised" License', "Revised BSD License", "Modified BSD License"],
    "Apache-2.0": ["Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/", "Apache License\nVersion 2.0, January 2004\nhttps://www.apache.org/licenses/", "", "Apache License\nVersion 2.0, January 2004"],
    "MPL-1.1": ["MOZILLA PUBLIC LICENSE\nVersion 1.1", "", "Mozilla Public License 1.1"], "MPL-2.0": ["Mozilla Public License Version 2.0", "", "Mozilla Public License, version 2.0"],
    "CC0-1.0": ["Creative Commons Legal Code\nCC0 1.0 Universal", "CC0 1.0 Universal", "", "Creative Commons CC0 1.0 Universal"],
    "BSL-1.0": ["Boost Software License - Version 1.0 - August 17th, 2003", "", "Boost Software License 1.0"],
    "Unlicense": ["", "The Unlicense", "Unlicense", "The Unlicense (Unlicense)"], "Zlib": ["", "zlib License", "The zlib License", "zlib/libpng License"],
    "GPL-1.0-only": ["GNU GENERAL PUBLIC LICENSE\nVersion 1, February 1989", ""], "GPL-2.0-only": ["GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991", ""], "GPL-3.0-only": ["GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007", ""],
    "LGPL-2.0-only": ["GNU LIBRARY GENERAL PUBLIC LICENSE\nVersion 2, June 1991", ""], "LGPL-2.1-only": ["GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999", ""], "LGPL-3.0-only": ["GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007", ""],
}
#: Patterns of the lines from which a text may be cut off, and of what may read otherwise.
ENDS = [r"END OF TERMS AND CONDITIONS", r"(?:Appendix:\s+)?How to Apply These Terms", r"APPENDIX: How to apply the Apache", r"EXHIBIT A -Mozilla", r"Exhibit A - Source", r"Exhibit B - \"Incompatible", r"For more information, please refer to <http"]
SWAPS = [
    (r"https?(?=://)", ["http", "https"]),
    (r"51 Franklin St(?:reet)?, Fifth Floor, Boston,? MA\s+02110-1301,?\s+USA", ["51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", "51 Franklin St, Fifth Floor, Boston, MA 02110-1301 USA", "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA", "59 Temple Place - Suite 330, Boston, MA 02111-1307, USA.", "675 Mass Ave, Cambridge, MA 02139, USA"]),
    (r"and/or(?= distribute this software)", ["and/or", "and"]),
    (r"(?m)^[123]\. (?=Redistributions|Neither)", [""]),
    (r"GNU Lesser General(?=\s+Public License instead)", ["GNU Lesser General", "GNU Library General"]),
]
#: Line lengths at which short texts are also known; a line that starts with the word copyright has no part in a form.
WIDTHS, SHORT = range(60, 101), 3_000
#: One-line notices.
NOTICES = {
    "Released under the MIT License.": "MIT", "Licensed under the MIT License.": "MIT", "SPDX-License-Identifier: MIT": "MIT",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only": "GPL-3.0-only",
    "Licensed under CC BY 4.0.": "CC-BY-4.0", "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "Released under the BSD License.": "BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause": "BSD-3-Clause", "SPDX-License-Identifier: ISC": "ISC",
}


def canonical(text: str) -> str:
    """The canonical form of a known text."""
    s = re.sub(COPYRIGHT, " ", text.translate(str.maketrans(UPPER, LOWER)))
    s = re.sub(r"[^a-z0-9\u0080-\U0010FFFF]+", " ", s)
    for a, b in SPELLING if ANY_SPELLING.search(s) else ():
        s = re.sub(a, b, s, flags=re.A)
    return s.strip(" ")


def canonical_form(text: Column) -> Column:
    """The same, as an expression."""
    s = F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), COPYRIGHT, " ")
    s = F.regexp_replace(s, r"[^a-z0-9\x{80}-\x{10FFFF}]+", " ")
    # one pass finds the texts that hold any of the spellings; few do
    respelt = s
    for a, b in SPELLING:
        respelt = F.regexp_replace(respelt, a, b)
    return F.trim(F.when(s.rlike(r"\b(?:" + "|".join(EQUAL) + r")\b"), respelt).otherwise(s))


def forms(name: str, text: str) -> list[str]:
    """The text in the usual forms of the licence: as given, with other titles, ends, wordings and line breaks."""
    if name not in TITLES:
        return [text]
    first = re.match(r"\s*" + r"\s+".join(map(re.escape, TITLES[name][0].split())), text)
    ends = [len(text), *(m.start() for p in ENDS for m in re.finditer(rf"(?m)^[ \t]*(?:{p})", text))]
    bodies = [text[first.end() if first else 0 : e] for e in ends]
    for pattern, choices in SWAPS:
        bodies = [x for b in bodies for x in (b, *(re.sub(pattern, c, b) for c in choices if re.search(pattern, b)))]
    titled = [f"{t}\n{b}" for t, b in product(TITLES[name] if first else [""], dict.fromkeys(bodies))]
    out = [text, *titled]
    for t in titled:
        paragraphs = [" ".join(x.split()) for x in (t.split("\n") if name in SHORT_LINES else re.split(r"\n[ \t]*\n", t))]
        out.append("\n".join(paragraphs))
        if len(t) < SHORT:
            out += ["\n".join(textwrap.fill(x, w, subsequent_indent=i) for x in paragraphs) for w, i in product(WIDTHS, ("", "   "))]
    return out


@lru_cache(None)
def _digests(name: str, text: str) -> list[str]:
    return list(dict.fromkeys(hashlib.sha256(canonical(x).encode()).hexdigest() for x in dict.fromkeys(forms(name, text))))


def digests(known: dict[str, str]) -> list[tuple[str, str]]:
    """(digest, licence) of the forms of texts by licence."""
    return [(d, name) for name, t in known.items() for d in _digests(name, t)]


def scan(docs: DataFrame, texts: dict[str, str] = TEXTS, notices: dict[str, str] = NOTICES) -> DataFrame:
    """(doc_id, canonical_sha256, license_id, notice_ids, n_notices): the licence that a whole text is, the sorted licences of its notice lines, and how many lines these are."""
    spark = docs.sparkSession
    whole = spark.createDataFrame([*digests(texts), *((d, notices[t]) for d, t in digests({t: t for t in notices}))], "digest string, license_id string").dropDuplicates(["digest"])
    of_line = F.create_map(*[F.lit(x) for t, name in notices.items() for x in (hashlib.sha256(canonical(t).encode()).hexdigest(), name)])
    # a form longer than every notice's is none, and isn't digested
    longest, text = max(len(canonical(t)) for t in notices), F.coalesce("text", F.lit(""))
    found = F.array_compact(F.transform(F.transform(F.split(text, "\n"), canonical_form), lambda x: F.when(F.length(x) <= longest, F.element_at(of_line, F.sha2(x, 256)))))
    d = docs.select("doc_id", F.sha2(canonical_form(F.col("text")), 256).alias("digest"), found.alias("found"))
    d = d.join(F.broadcast(whole), "digest", "left")
    return d.select("doc_id", F.col("digest").alias("canonical_sha256"), "license_id", F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("notice_ids"), F.size("found").cast("long").alias("n_notices"))
