"""Spaced numbers and written-out addresses are found by their contexts."""

from tidewatch.llm import personal_data

NUMBERS = ["555 123 4567", "0301 234 56", "(030) 1234 567", "020 7946 0958", "555.123.4567"]
ADDRESSES = ["jane.doe(at)example.org", "jane.doe [at] example [dot] org", "jane at example dot org",
             "jane@example[dot]org"]


def test_contexts_find_spaced_numbers_and_written_addresses(spark):
    rows = [(k, f"Note {k}. please ring me on +1 (555) 010-{1000 + k} before noon") for k in range(26)]
    rows += [(40 + k, f"Note {k}. please write to us via joe{chr(97 + k)}@example.org before noon") for k in range(26)]
    rows += [(100 + k, f"Hello. please ring me on {v} before noon") for k, v in enumerate(NUMBERS)]
    rows += [(200 + k, f"Hello. please write to us via {v} before noon") for k, v in enumerate(ADDRESSES)]
    rows += [(300, "Totals of 666 123 4567 altogether"), (301, "look at this dot there"),
             (302, "please ring me on " + "1 " * 40 + "before noon")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    text = dict(rows)
    got = {r.doc_id: r for r in personal_data.personal_data(docs).collect()}
    for first, kind, values in ((100, "phone", NUMBERS), (200, "email", ADDRESSES)):
        for k, v in enumerate(values):
            at = text[first + k].index(v)
            assert got[first + k].spans == f"{kind}:{at}:{at + len(v)}", v
            assert got[first + k].n_added == 1 and got[first + k][f"n_{kind}"] == 0
    assert all(got[i].n_added == 0 for i in (300, 301, 302))
