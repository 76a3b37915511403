"""License recognition by sentence identifiers and ordered rules.

A text is cut into sentences, over wrapped lines and behind comment marks; each is normalised and looked up among the
sentences that licenses are known to use.  The identifiers found, in order, are
then matched against ordered rules; what a rule has matched is consumed, so the
more specific rule stands first.  All of it works inside the row.

Defined results: a NULL or empty text has no sentences and no license; repeated
rows stay; very long texts are scanned whole; an empty table gives no rows; columns that are not asked for are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.arrays import let

#: Identifier -> the wordings of its sentence.  Fixed values: the standard texts and notices.
WORDINGS = {
    "Apache2Lic": [
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License)",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License",
        "Released under the Apache License 2.0",
    ],
    "ApacheUse": ["you may not use this file except in compliance with the License"],
    "ApacheCopy": [
        "You may obtain a copy of the License at",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0",
    ],
    "ApacheBasis": [
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    ],
    "ApacheSee": ["See the License for the specific language governing permissions and limitations under the License"],
    "MITTitle": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "MITLic": [
        "Released under the MIT License",
        "This software is released under the MIT License",
        "Licensed under the MIT License",
    ],
    "MITPerm": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    ],
    "MITNotice": [
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
        "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software",
    ],
    "AsIs": [
        "The software is provided as is, without warranty of any kind, express or implied",
        "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement",
    ],
    "MITLiable": [
        "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software",
    ],
    "GPL3Lic": [
        "This work is licensed under the GNU General Public License version 3",
        "Licensed under the GNU General Public License version 3",
    ],
    "GPL2Lic": [
        "This work is licensed under the GNU General Public License version 2",
        "Licensed under the GNU General Public License version 2",
    ],
    "GPLFree": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    ],
    "GPL3Later": ["either version 3 of the License, or (at your option) any later version"],
    "GPL2Later": ["either version 2 of the License, or (at your option) any later version"],
    "GPL3Free": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ],
    "GPL2Free": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    ],
    "GPL3Sole": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation",
    ],
    "GPL2Sole": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    ],
    "LGPL3Free": [
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ],
    "LGPL21Free": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    ],
    "AGPL3Free": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ],
    "AnyLater": ["or (at your option) any later version"],
    "GNUHope": [
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    ],
    "GNUSee": [
        "See the GNU General Public License for more details",
        "See the GNU Lesser General Public License for more details",
        "See the GNU Affero General Public License for more details",
    ],
    "GPLCopy": [
        "You should have received a copy of the GNU General Public License along with this program",
        "You should have received a copy of the GNU Lesser General Public License along with this program",
        "You should have received a copy of the GNU Lesser General Public License along with this library",
        "You should have received a copy of the GNU Affero General Public License along with this program",
        "You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA",
        "You should have received a copy of the GNU General Public License along with this program; if not, see https://www.gnu.org/licenses/",
    ],
    "GNUElse": ["If not, see http://www.gnu.org/licenses/", "If not, see https://www.gnu.org/licenses/"],
    "MPLLic": ["This Source Code Form is subject to the terms of the Mozilla Public License, v"],
    "MPL2Copy": [
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    ],
    "ISCPerm": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    ],
    "ISCAsIs": [
        "The software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    ],
    "ISCLiable": [
        "In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software",
    ],
    "CCByNc4": [
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ],
    "CCBy4": [
        "Licensed under CC BY 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
    ],
    "CCBySa4": [
        "Licensed under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ],
    "BSDPre": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "BSDSource": [
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    ],
    "BSDBinary": [
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    ],
    "BSDEndorse": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "BSDAsIs": [
        "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    ],
    "BSDLiable": [
        f"In no event shall the copyright {who} or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage"
        for who in ("holder", "holders", "owner")
    ],
    "AllRights": ["All rights reserved"],
}
#: Normalised sentence -> identifier.
SENTENCES = {
    re.sub(r"[^a-z0-9]+", " ", wording.lower()).strip(): name
    for name, wordings in WORDINGS.items()
    for wording in wordings
}

#: License -> identifiers in order; a bracketed one may be missing.  The first
#: rules win.  Fixed values.
RULES = [
    ("AGPL-3.0-or-later", "AGPL3Free [GNUHope] [GNUSee] [GPLCopy] [GNUElse]"),
    ("LGPL-3.0-or-later", "LGPL3Free [GNUHope] [GNUSee] [GPLCopy] [GNUElse]"),
    ("LGPL-2.1-or-later", "LGPL21Free [GNUHope] [GNUSee] [GPLCopy] [GNUElse]"),
    ("GPL-3.0-or-later", "GPL3Free [GNUHope] [GNUSee] [GPLCopy] [GNUElse]"),
    ("GPL-2.0-or-later", "GPL2Free [GNUHope] [GNUSee] [GPLCopy] [GNUElse]"),
    ("GPL-3.0-only", "GPL3Sole [GNUHope] [GNUSee] [GPLCopy] [GNUElse]"),
    ("GPL-2.0-only", "GPL2Sole [GNUHope] [GNUSee] [GPLCopy] [GNUElse]"),
    ("GPL-3.0-or-later", "GPL3Lic AnyLater"),
    ("GPL-3.0-or-later", "GPLFree GPL3Later [GPLCopy]"),
    ("GPL-2.0-or-later", "GPL2Lic AnyLater"),
    ("GPL-2.0-or-later", "GPLFree GPL2Later [GPLCopy]"),
    ("GPL-3.0-only", "GPL3Lic [GPLCopy]"),
    ("GPL-2.0-only", "GPL2Lic [GPLCopy]"),
    ("Apache-2.0", "Apache2Lic [ApacheUse] [ApacheCopy] [ApacheBasis] [ApacheSee]"),
    ("MIT", "[MITTitle] [AllRights] MITPerm MITNotice [AsIs] [MITLiable]"),
    ("MIT", "MITLic [MITPerm] [MITNotice] [AsIs] [MITLiable]"),
    ("ISC", "ISCPerm [ISCAsIs] [ISCLiable]"),
    ("MPL-2.0", "[MPLLic] MPL2Copy"),
    ("BSD-3-Clause", "[AllRights] BSDPre BSDSource BSDBinary BSDEndorse [BSDAsIs] [BSDLiable]"),
    ("BSD-2-Clause", "[AllRights] BSDPre BSDSource BSDBinary [BSDAsIs] [BSDLiable]"),
    ("CC-BY-NC-4.0", "CCByNc4"),
    ("CC-BY-SA-4.0", "CCBySa4"),
    ("CC-BY-4.0", "CCBy4"),
]

#: Ends of sentences: a full stop before white space, a line without letters or digits, a
#: list number that begins a line.  Other line ends only wrap a sentence.
SENTENCE_END = (
    r"[.!?]+[\"')\]]*[ \t\r\n\x0b\x0c]+"
    r"|\n[^a-z0-9\n]*\n"
    r"|\n[^a-z0-9\n]*(?:[0-9]{1,2}[.)]|\([a-z0-9]\))[ \t]+"
)
#: Ends of the clauses that an unknown sentence is looked up by, besides line ends.
CLAUSE_END = r"[:;]+[ \t\r]+"
#: A holder's own name in a sentence, and what stands for it.
HOLDER = (
    r"neither[ \n]the[ \n]name[ \n]of[ \n][a-z0-9 \n]{1,120}?[ \n]nor[ \n]the[ \n]names[ \n]of[ \n]"
    r"(?:its|their|the|any)[ \n]contributors"
)
HOLDER_PLAIN = "neither the name of the copyright holder nor the names of its contributors"
#: Words that make an unknown sentence worth reporting.
HINT = "license"


def rule_pattern(sequence: str) -> str:
    """The regular expression of a rule over `` id  id `` (blanks on both sides)."""
    return "".join(
        f"( {part[1:-1]} )?" if part.startswith("[") else f" {part} " for part in sequence.split()
    )


def sentences(text: Column) -> Column:
    """Normalised sentences in order: lower-case letters and digits between single blanks.

    A sentence that is not known as a whole stands as its clauses, one a line.
    """
    ended = F.regexp_replace(F.lower(text), SENTENCE_END, "\f")
    plain = F.regexp_replace(F.regexp_replace(ended, CLAUSE_END, "\n"), r"[^a-z0-9\n\f]+", " ")
    lines = F.regexp_replace(F.regexp_replace(plain, r" *\n[ \n]*", "\n"), HOLDER, HOLDER_PLAIN)
    whole = lambda b: F.trim(F.translate(b, "\n", " "))
    clauses = lambda b: F.transform(F.split(b, "\n"), lambda c: F.trim(c))
    known = lambda b: F.when(whole(b).isin(*SENTENCES), F.array(whole(b))).otherwise(clauses(b))
    return F.flatten(F.transform(F.split(lines, "\f"), known))


def recognise(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, ``sentence_ids``, ``licenses`` in the order of the rules, ``n_unknown``.

    ``n_unknown`` counts sentences that mention a license but are not known, and
    identifiers that no rule has consumed.
    """
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    kept = [F.col(f"`{c}`") for c in keep]
    none = F.array().cast("array<string>")

    def named(found: Column) -> Column:
        ids = F.transform(F.filter(found, lambda s: s.isin(*SENTENCES)), lambda s: F.element_at(known, s))
        odd = F.size(F.filter(found, lambda s: s.contains(HINT) & ~s.isin(*SENTENCES)))
        return F.struct(ids.alias("ids"), odd.alias("odd"))

    found = F.when(F.col(text).isNotNull(), let(sentences(F.col(text)), named))
    rows = docs.select(*kept, found.alias("_found"))

    def consume(ids: Column) -> Column:
        line = F.concat(F.lit(" "), F.array_join(ids, "  "), F.lit(" "))
        start = F.struct(line.alias("line"), none.alias("licenses"))
        rules = F.array(
            *[
                F.struct(F.lit(name).alias("name"), F.lit(rule_pattern(seq)).alias("pattern"))
                for name, seq in RULES
            ]
        )
        return F.aggregate(
            rules,
            start,
            lambda state, rule: F.struct(
                F.regexp_replace(state["line"], rule["pattern"], F.lit(" # ")).alias("line"),
                F.when(
                    F.regexp_like(state["line"], rule["pattern"]),
                    F.array_append(state["licenses"], rule["name"]),
                )
                .otherwise(state["licenses"])
                .alias("licenses"),
            ),
        )

    ids = F.coalesce(F.col("_found.ids"), none)
    left = F.size(F.filter(F.split(F.trim(F.col("_state.line")), " +"), lambda x: ~x.isin("#", "")))
    return rows.select(
        *kept,
        "_found",
        F.when(F.size(ids) > 0, consume(ids))
        .otherwise(F.struct(F.lit("").alias("line"), none.alias("licenses")))
        .alias("_state"),
    ).select(
        *kept,
        ids.alias("sentence_ids"),
        F.array_distinct("_state.licenses").alias("licenses"),
        (F.coalesce(F.col("_found.odd"), F.lit(0)) + left).cast("long").alias("n_unknown"),
    )
