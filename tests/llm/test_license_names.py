"""Short license notices differ in one word, which a match must hold."""

from veilspark.llm import license_scan


def test_short_notices_need_their_names(spark):
    want = {
        "This is licensed under the GNU General Public License.": "gpl",
        "licensed under the GNU General Public License, version 3": "gpl",
        "The parts are released under the same license.": "",
        "It is released under the MIT license.": "mit",
        "licensed under the license, version 2.0": "",
        "licensed under the 3-clause license": "",
    }
    docs = spark.createDataFrame([(t, t) for t in want], "doc_id string, text string")
    assert {r["doc_id"]: r["labels"] for r in license_scan.scan_licenses(docs).collect()} == want


def test_longer_names_explain_the_plain_one():
    counts = dict.fromkeys((w for _, t in license_scan.NOTICES for w in license_scan.plain_words(t.encode())), 1)
    index = license_scan.NoticeIndex(license_scan.NOTICES, counts, license_scan.THRESHOLD)
    for label, name in (("lgpl", "Lesser"), ("agpl", "Affero")):
        block = set(license_scan.plain_words(f"licensed under the GNU {name} General Public License".encode()))
        assert {found for found, _ in index.named(block)} == {label}
