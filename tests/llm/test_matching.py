"""Decontamination and personal data against brute force on small tables."""

import hashlib
import random
import re

import pytest

from tidewatch.llm import decontaminate, personal_data

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def plain_contamination(docs, items, run=10):
    views = {}
    for item, text in items:
        w = words(text)
        for s in range(max(len(w) - run + 1, 1) if w else 0):
            views.setdefault(tuple(w[s:s + run]), set()).add(item)
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(v) for v in views}:
            for s in range(len(w) - n + 1):
                if tuple(w[s:s + n]) in views:
                    hit |= set(range(s, s + n))
                    found |= views[tuple(w[s:s + n])]
        ids = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(4)
    vocabulary = ["the", "of", "Éa", "ñu", "x9", "一", "qu", "zebra", "Ox", "ß"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(1, text(30)), (2, text(14)), (2, text(11)), (3, "Only four words here"), (4, "zebra"),
             (5, ""), (6, None), (None, text(12)), (7, "!!! ???"), (8, text(10))]
    docs = [(k, text(rng.randint(0, 40))) for k in range(30)]
    docs += [(50 + k, f"{text(9)}, {(t or '').upper() if k % 2 else t}... {text(7)}") for k, (_, t) in enumerate(items)]
    docs += [(70, "\n".join(f"{t}" for _, t in items)), (71, None), (72, ""), (None, items[0][1]),
             (73, "only FOUR-words_here"), (73, "only FOUR-words_here"), (74, text(20000))]
    return docs, items


def frames(spark, docs, items):
    return (spark.createDataFrame([(i, t, "r", 1, 2) for i, t in docs],
                                  "doc_id long, text string, item_id string, row int, pos int"),
            spark.createDataFrame([(i, t, "w") for i, t in items], "item_id long, text string, word string"))


@pytest.mark.parametrize("broadcast_terms", [200_000, 0])
def test_windows_are_found_whatever_their_words(spark, broadcast_terms):
    docs, items = corpus()
    got = decontaminate.contamination(*frames(spark, docs, items), broadcast_terms=broadcast_terms)
    assert sorted((tuple(r)[:6] for r in got.collect()), key=repr) == plain_contamination(docs, items)


def test_proximity(spark):
    item = "alpha bravo charlie delta echo foxtrot golf hotel india juliet"
    swapped = item.replace("charlie delta", "delta charlie")
    spread = item.replace("echo", "echo uh um")
    docs = [(1, item), (2, swapped), (3, spread), (4, item.replace("golf", "tango"))]
    got = {r.doc_id: (r.contaminated, r.n_near > 0) for r in decontaminate.contamination(
        *frames(spark, docs, [(1, item)])).collect()}
    assert got == {1: (True, False), 2: (False, True), 3: (False, True), 4: (False, False)}


def test_no_documents_or_no_items(spark):
    docs, items = corpus()
    d, i = frames(spark, docs, items)
    assert decontaminate.contamination(d.limit(0), i).count() == 0
    rows = decontaminate.contamination(d, i.limit(0)).collect()
    assert len(rows) == len(docs) and not any(r.contaminated for r in rows)


PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def valid(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == 1:
        return all(int(p) <= 255 for p in text.split("."))
    if kind == 2:
        doubled = [int(c) * (2 if k % 2 else 1) for k, c in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0
    return kind == 0 or 9 <= len(digits) <= 15


def plain_spans(text):
    found = [(m.start(), k, m.end()) for k, p in enumerate(PATTERNS)
             for m in re.finditer(p, text or "") if valid(k, m.group())]
    return ",".join(f"{personal_data.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


def test_seed_spans(spark):
    rng = random.Random(9)
    parts = ["a.b@c-d.ex", "@", "x@y", "x@y.z.", "1.2.3.4", "256.1.1.1", "1.2.3.4.5", "007.08.0.255",
             "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (234) 555-0199", "+12", "+44 20 7946 0958 12 34",
             "é", "😀", " ", "\n", "-", ".", "12345678901234567890123", "0", "a", "5500005555555559"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", ""]) for _ in range(rng.randint(0, 9)))
             for _ in range(400)] + [None, "", "7" * 20000, "1 " * 9000, "1." * 9000, "a" * 9000 + "@",
                                     "+1" + "-1" * 6000, "x@" + "a." * 4000 + "b"]
    docs = spark.createDataFrame([(k, t, "b") for k, t in enumerate(texts)], "doc_id long, text string, base string")
    got = {r.doc_id: r for r in personal_data.personal_data(docs).collect()}
    for k, text in enumerate(texts):
        spans = plain_spans(text)
        assert got[k].base_sha256 == hashlib.sha256(spans.encode()).hexdigest(), (text or "")[:80]
        assert [got[k][f"n_{n}"] for n in personal_data.KINDS] == [
            len(re.findall(f"{n}:", spans)) for n in personal_data.KINDS]
        assert set(filter(None, spans.split(","))) <= set(got[k].spans.split(","))


def test_contexts_of_seeds_discover_unseen_identifiers(spark):
    rows = [(k, f"Note {k}. please ring me on +1 (555) 010-{1000 + k} before noon") for k in range(8)]
    rows += [(100, "Hello. please ring me on 0049-30-12b345 before noon"),
             (101, "Totals were 0049-30-99x345 altogether"), (102, "please ring me on 0049-30-12b345 before noon"),
             (103, "write 0049-30-12b345 down")]
    rows += [(200 + k, "Same text: code z9 is +1 (777) 010-7777 now") for k in range(50)]  # copies are one
    rows += [(300, "Same text: code z9 is 8888-77-66a now")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in personal_data.personal_data(docs).collect()}
    text = dict(rows)
    for k in (100, 102, 103):  # believed from its contexts, then marked wherever it stands
        at = text[k].index("0049")
        assert f"phone:{at}:{at + 14}" in got[k].spans and got[k].n_added == 1 and got[k].n_phone == 0
    assert got[101].n_added == 0 and got[300].n_added == 0
    assert personal_data.personal_data(docs.limit(0)).count() == 0
