"""Repeated passages are found to their edges, also inside one document."""

import random

from helpers import awkward

from emberfield.llm import substring


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9))) for _ in range(n))


def test_passages_of_51_words_are_found_whole(spark):
    rng, rows = random.Random(11), []
    for k in range(300):
        passage = prose(rng, 51)
        for i in range(2):
            rows.append((10 * k + i, f"{prose(rng, 30)}{'<>'[i]}{passage}{'()'[i]}{prose(rng, 30)}"))
    spans = {r.doc_id: r for r in substring.repeated_spans(awkward(spark, rows)).collect()}
    missed = [i for i, t in rows if i % 10 == 1 and not (
        i in spans and spans[i].start <= t.index(">") + 1 and spans[i].stop >= t.index(")") and i - 1 in spans[i].first_doc_ids)]
    assert not missed and {i % 10 for i in spans} == {1}
    assert all(spans[i].stop - spans[i].start <= t.index(")") - t.index(">") + 30 for i, t in rows if i % 10 == 1)


def test_repeats_inside_a_document_and_of_one_word(spark):
    rng = random.Random(12)
    passage, lead = prose(rng, 60), [prose(rng, n) for n in (31, 40, 22, 35)]
    inner = f"{lead[0]}<{passage}>{lead[1]}({passage}){lead[2]}"
    rows = [(1, inner), (2, f"{lead[3]} {'again ' * 120}!"), (3, f"{lead[2][:50]}:{'again ' * 120}?")]
    spans = substring.repeated_spans(awkward(spark, rows)).collect()
    at = inner.index("(") + 1
    assert [(r.start, r.stop, r.first_doc_ids) for r in spans if r.doc_id == 1] == [(at, at + len(passage), [1])]
    last = {r.doc_id: r.stop - r.start for r in spans if r.doc_id == 3}
    assert last[3] >= 6 * 110


def test_texts_are_told_apart_by_id_and_text(spark):
    """Rows without an id are searched too; an id with two texts is two documents, cut apart."""
    rng = random.Random(13)
    passage, other = prose(rng, 60), prose(rng, 60)
    lead = [prose(rng, 20) for _ in range(8)]
    texts = [(None, f"{lead[0]}<{passage}>{lead[1]}"), (None, f"{lead[2]}({passage}){lead[3]}"), (5, f"{lead[4]}[{other}]{lead[5]}"),
             (5, lead[6]), (9, f"{lead[7]}({other})"), (5, f"{lead[4]}[{other}]{lead[5]}")]
    docs = awkward(spark, texts)
    spans = substring.repeated_spans(docs).collect()
    assert sorted((str(r.doc_id), r.first_doc_ids, r.stop - r.start) for r in spans) == [("9", [5], len(other)), ("None", [], len(passage))]
    left = sorted((str(r.doc_id), r.text) for r in substring.without_repeats(docs).select("doc_id", "text").collect())
    cut = {(i, t) for i, t in left}
    assert ("9", f"{lead[7]}()") in cut and ("5", lead[6]) in cut and left.count(("5", texts[2][1])) == 2
    assert sum(passage in t for i, t in cut if i == "None") == 1


def test_every_stretch_is_an_earlier_substring(spark, monkeypatch):
    """Against a search over all substrings: nothing reported is new text, and no long repeat is left, on either way of joining."""
    rng = random.Random(14)
    pool = [prose(rng, 40) for _ in range(12)]
    rows = [(i, " ".join(rng.choice([prose(rng, rng.randrange(1, 30)), rng.choice(pool)]) for _ in range(6))) for i in range(60)]
    for bound in (substring.REPEATED_KEYS, 0):
        monkeypatch.setattr(substring, "REPEATED_KEYS", bound)
        spans = {}
        for r in substring.repeated_spans(awkward(spark, rows)).collect():
            spans.setdefault(r.doc_id, []).append((r.start, r.stop))
        seen, windows, found = "", 0, 0
        for i, text in rows:
            for start, stop in spans.get(i, []):
                for at in range(start, stop, 7):  # a stretch may join runs from different places
                    assert any(text[b:b + 24] in seen + "\n" + text[:b + 23] for b in (at, at - 8, at - 16, at - 23))
            for at in range(0, len(text) - 250, 10):
                if text[at:at + 250] in seen:
                    windows += 1
                    found += any(a <= at + 20 and at + 230 <= b for a, b in spans.get(i, []))
            seen += "\n" + text
        assert windows > 50 and found >= 0.97 * windows
