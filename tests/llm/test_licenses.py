import pytest

from tidepool.llm import license_scan as ls


def test_entire_texts_whatever_their_dress(spark):
    mit = "Copyright (c) 2020 Someone\nAll rights reserved.\n\n" + ls.KNOWN["MIT"].upper().replace(", ", " ,\n") + "\n"
    rows = [(1, mit), (2, ls.KNOWN["BSD-3-Clause"].replace("1. ", "(1)  ")), (3, "some text\nReleased under the MIT Licence!"), (4, None), (5, ""), (6, "*** ..."), (7, ls.KNOWN["MIT"] + " more"), (8, "x " * 50000), (1, mit)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'a' as license_id", "'b' as text_digest", "1 as _id")
    out = ls.license_scan(docs).collect()
    assert sorted(r.doc_id for r in out) == sorted(r[0] for r in rows), "a row for each row"
    got = {r.doc_id: r for r in out}
    assert {i: r.license_id for i, r in got.items()} == {1: "MIT", 2: "BSD-3-Clause", 3: None, 4: None, 5: None, 6: None, 7: None, 8: None}
    assert got[3].notices == "MIT notice" and got[4].text_digest == got[5].text_digest == got[6].text_digest
    assert ls.license_scan(docs.limit(0)).count() == 0


def test_known_texts_of_the_caller(spark):
    docs = spark.createDataFrame([(1, "My  own, LICENCE")], "doc_id long, text string")
    assert ls.license_scan(docs, known={"own": "my own license", "b": "other"}).first().license_id == "own"
    with pytest.raises(Exception, match="nothere"):
        ls.license_scan(docs, text_col="nothere").collect()


def test_full_texts_are_known(spark):
    known = ls.known_licenses()
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "MPL-2.0", "CC0-1.0"} <= set(known)
    rows = [(i, f"\n{text.upper()}  ") for i, text in enumerate(known.values())] + [(None, known["MIT"]), (None, known["MIT"]), (99, known["GPL-3.0"][:5000])]
    got = ls.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and all(r.license_id is not None for r in got if r.doc_id != 99) and [r.license_id for r in got if r.doc_id == 99] == [None]
    assert [r.license_id for r in got if r.doc_id is None] == ["MIT", "MIT"]
    assert {list(known)[r.doc_id] for r in got if r.doc_id not in (None, 99)} >= {r.license_id for r in got if r.license_id}


def test_a_hot_text(spark):
    docs = spark.range(2000).selectExpr("id as doc_id", "if(id % 3 = 0, 'x\\nReleased under the MIT License.', concat('own ', id)) as text")
    got = ls.license_scan(docs).groupBy("notices").count().collect()
    assert {(r.notices, r["count"]) for r in got} == {("MIT notice", 667), ("", 1333)}


def test_headings_list_marks_and_addresses(spark):
    """Ordinary licence files: under their usual heading, with other list marks, with an older address."""
    k, holder = ls.known_licenses(), "\n\nCopyright (c) 2019-2021, Some One <a@b.c>\n\n"
    bsd3, gpl = k["BSD-3-Clause"], k["GPL-2.0"]
    rows = [
        ("MIT", "MIT License" + holder + k["MIT"]), ("MIT", "The MIT License (MIT)" + holder + k["MIT"]), ("MIT", "# The MIT License" + holder + k["MIT"]), ("ISC", "ISC License" + holder + k["ISC"]), ("ISC", "The ISC License (ISC)" + holder + k["ISC"]),
        ("BSD-3-Clause", "BSD 3-Clause License" + holder + bsd3), ("BSD-3-Clause", "The 3-Clause BSD License" + holder + bsd3.replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* ")), ("BSD-3-Clause", bsd3.replace("1. ", "a) ").replace("2. ", "b) ").replace("3. ", "c) ")),
        ("BSD-2-Clause", "Simplified BSD License" + holder + k["BSD-2-Clause"].replace("1. ", "- ").replace("2. ", "- ")), ("Zlib", "zlib License" + holder + k["Zlib"]), (None, "MIT License"), (None, "MIT License and more " + k["MIT"]), (None, "the mit license says permission is given"),
    ]
    address = next(a for a in ("51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", "51 Franklin Street, Fifth Floor, Boston, MA 02110-1301, USA", "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA", "59 Temple Place, Suite 330, Boston, MA  02111-1307  USA", "51 Franklin Street, Fifth Floor,\n Boston, MA 02110-1301 USA", "") if a in gpl)
    if address:
        rows.append(("GPL-2.0", gpl.replace(address, "59 Temple Place, Suite 330, Boston, MA  02111-1307  USA")))
        rows.append(("GPL-2.0", gpl.replace(address, "675 Mass Ave, Cambridge, MA 02139, USA")))
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.license_id for r in ls.license_scan(docs).collect()}
    assert got == {i: want for i, (want, _) in enumerate(rows)}
