"""Whole notices as they stand in files: wrapped, behind comment marks, on one line."""

import textwrap

import pytest

from tallyweave.llm import licenses, quality, queries
from tallyweave.llm.common import read
from tests.llm.test_operators import documents


def of(name, number=0):
    return licenses.WORDINGS[name][number]


MIT = "\n\n".join(
    ["MIT License", "Copyright (c) 2020 Somebody", of("MITPerm", 1) + ":", of("MITNotice") + ".", f"{of('AsIs', 1).upper()}. {of('MITLiable').upper()}."]
)
BSD_HEAD = "Copyright (c) 2011, A Company, Inc. All rights reserved."
BSD_END = f"{of('BSDAsIs').upper()}. {of('BSDLiable').upper()}."
BSD2 = "\n\n".join([BSD_HEAD, of("BSDPre") + ":", "1. " + of("BSDSource") + ".", "2. " + of("BSDBinary") + ".", BSD_END])
BSD3 = "\n\n".join(
    [BSD_HEAD, of("BSDPre") + ":\n1. " + of("BSDSource") + ".\n2. " + of("BSDBinary") + ".\n3. "
     + of("BSDEndorse").replace("the copyright holder", "A Company, Inc") + ".", BSD_END]
)
APACHE = "\n\n".join([of("Apache2Lic", 2) + ".\n" + of("ApacheCopy"), "    http://www.apache.org/licenses/LICENSE-2.0", of("ApacheBasis") + ".\n" + of("ApacheSee") + "."])
GPL3 = "\n\n".join([of("GPL3Free") + ".", of("GNUHope") + ".  " + of("GNUSee") + ".", of("GPLCopy") + ".  If not, see <https://www.gnu.org/licenses/>."])
GPL2 = "\n\n".join([of("GPL2Free") + ".", of("GNUHope") + ".  " + of("GNUSee") + ".", of("GPLCopy", 4) + "."])
LGPL21 = of("LGPL21Free") + "."
ISC = "\n\n".join([of("ISCPerm") + ".", of("ISCAsIs").upper() + ". " + of("ISCLiable").upper() + "."])
MPL = of("MPLLic") + ". 2.0. " + of("MPL2Copy") + "."
NOTICES = {
    "MIT": MIT, "BSD-2-Clause": BSD2, "BSD-3-Clause": BSD3, "Apache-2.0": APACHE, "GPL-3.0-or-later": GPL3,
    "GPL-2.0-or-later": GPL2, "LGPL-2.1-or-later": LGPL21, "ISC": ISC, "MPL-2.0": MPL,
}


def wrapped(text, width, mark=""):
    lines = []
    for part in text.split("\n"):
        lines += textwrap.wrap(part, width) or [""]
    return "\n".join((mark + line).rstrip() for line in lines)


@pytest.mark.parametrize("form", ["plain", "wrapped", "hash", "star", "line"])
def test_whole_notices(spark, form):
    shape = {
        "plain": lambda t: t,
        "wrapped": lambda t: wrapped(t, 70),
        "hash": lambda t: wrapped(t, 60, "# ") + "\n#\nimport os\n",
        "star": lambda t: "/*\n" + wrapped(t, 50, " * ") + "\n */\nint x;\n",
        "line": lambda t: "Words before it. " + t.replace("\n", " ") + " And after it.",
    }[form]
    # Without line ends a title or a copyright without a full stop belongs to the sentence behind it.
    named = {n: t[t.index("Permission") :] if n == "MIT" else t for n, t in NOTICES.items()} if form == "line" else NOTICES
    rows = licenses.recognise(documents(spark, [shape(t) for t in named.values()]), ["doc_id"]).orderBy("doc_id").collect()
    assert [r["licenses"] for r in rows] == [[n] for n in named]


def test_odd_texts(spark):
    long = "A line of words that goes on\n" * 40_000 + "\n\n" + wrapped(MIT, 70) + "\n\n" + "\n" * 50_000 + "# " * 50_000
    texts = [long, "", None, "\n\n\n", "\f", GPL3, GPL3, wrapped(MIT, 70) + "\n\n" + wrapped(APACHE, 70), "Some other license here."]
    rows = licenses.recognise(documents(spark, texts), ["doc_id", "size"]).orderBy("doc_id").collect()
    assert [r["licenses"] for r in rows] == [
        ["MIT"], [], [], [], [], ["GPL-3.0-or-later"], ["GPL-3.0-or-later"], ["Apache-2.0", "MIT"], []]
    assert [r["n_unknown"] for r in rows][-1] == 1
    assert licenses.recognise(documents(spark, []), ["doc_id"]).collect() == []


def test_ablations_over_the_stored_ledger(spark):
    folder = "/root/testdata/sf0.01"
    rows = queries.QUERIES["op10_quality"](spark, folder).select("failed_rules", "kept").toPandas()
    entries = quality.ledger(read(spark, folder, "documents"), ["doc_id"])
    found = {(r["version"], r["rule"]): r for r in quality.ablations(entries).collect()}
    assert {*found} == {(v, r) for v in quality.POLICIES for r in quality.RULES}
    for (version, rule), r in found.items():
        under = rows["failed_rules"] & quality.POLICIES[version]
        bit = quality.BITS[rule]
        want = ((rows["failed_rules"] & bit) != 0).sum(), (under == bit).sum(), (under != 0).sum()
        assert (r["failing"], r["alone"], r["rejected"]) == want
    assert ((rows["failed_rules"] & quality.POLICIES[quality.CURRENT]) == 0).equals(rows["kept"])
