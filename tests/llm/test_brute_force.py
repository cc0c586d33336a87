"""Operators against slow and plain versions of the same rule, on small tables."""

import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftwork.llm import components, decontamination, near_dedup, pseudonyms, segmentation, toxicity
from weftwork.llm.common import Scratch


def edit_distance(item, text):
    """The least distance between the item and any part of the text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != x)))
        row = new
    return min(row)


def test_decontamination_of_all_items_and_texts(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BUFFER_CHARS", 500)
    r = random.Random(5)
    words = "alpha beta gamma delta river stone over under 12 7 x".split()
    items = [(k, " ".join(r.choice(words) for _ in range(r.randint(1, 12)))) for k in range(25)]

    def mangled(text):
        out = list(text)
        for _ in range(r.randint(0, 1 + len(out) // 10)):
            at = r.randrange(len(out))
            out[at : at + r.randint(0, 1)] = r.choice(["", "q", "zz"])
        return "".join(out) or "q"

    texts = [(k, " ".join([*(r.choice(words) for _ in range(r.randint(0, 9))), mangled(r.choice(items)[1]), *(r.choice(words) for _ in range(r.randint(0, 9)))])) for k in range(60)]
    want = {}
    for k, text in texts:
        plain, held = decontamination.normalised(text), {}
        for i, item in items:
            item = decontamination.normalised(item)
            budget = len(item) * decontamination.EDITS_PERCENT // 100
            whole = item if len(item) >= decontamination.SHORTEST else f" {item} "
            if (d := edit_distance(whole, f" {plain} ")) <= budget:
                held[i] = d
        copies = [i for i in held if not (len(decontamination.normalised(items[i][1])) < decontamination.SHORTEST and " " not in decontamination.normalised(items[i][1]) and decontamination.normalised(items[i][1]) != plain)]
        want[k] = (bool(copies), sorted(held), [held[i] for i in sorted(held)])
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    for size in (1_000_000, 60):
        monkeypatch.setattr(decontamination, "BLOCK_CHARS", size)
        assert {x.doc_id: (x.contaminated, x.item_ids, x.distances) for x in decontamination.contamination(docs, bench).collect()} == want
        assert {x.doc_id for x in decontamination.uncontaminated(docs, bench).collect()} == {k for k, w in want.items() if not w[0]}


def test_toxicity_by_scanning_every_term():
    r = random.Random(6)
    lexicon = toxicity.Lexicon((("idiot", True, 1.0), ("zorg", False, 0.5), ("scum", True, 0.7)), ("pond scum", "idiot proof"), 0.01)
    matcher = toxicity.Matcher(lexicon)
    pieces = ["idiot", "1d10t", "iDiot!", "idiots", "zorgblat", "z0rg", "azorg", "scum", "pond scum", "p0nd 5cum", "idiot proof", "tree", "ѕсum", "river", "ok.", "x" * 30]
    for _ in range(300):
        text = " ".join(r.choice(pieces) for _ in range(r.randint(1, 12)))
        plain = unicodedata.normalize("NFKC", text).translate(toxicity.ZERO_WIDTH).lower() if not text.isascii() else text.lower()
        folded, total = plain.translate(toxicity.FOLD), 0.0

        def spans(term, whole, plain=plain, folded=folded):
            key = term.translate(toxicity.FOLD)
            for a in range(len(folded) - len(key) + 1):
                b = a + len(key)
                if folded[a:b] == key and not (a and plain[a - 1].isalnum()) and not (whole and b < len(plain) and plain[b].isalnum()):
                    yield a, b

        free = [s for e in lexicon.exceptions for s in spans(e, True)]
        for term, whole, weight in lexicon.terms:
            total += sum(weight for a, b in spans(term, whole) if not any(x <= a and b <= y for x, y in free))
        assert matcher.density(text) == pytest.approx(total / len(text.encode().split())), text


DATES = [(y, m, d) for y, m, d in ((2021, 3, 4), (1999, 12, 25), (2007, 11, 11), (1950, 1, 31), (2030, 10, 9))]


def test_pseudonyms_link_all_spellings():
    p, q = pseudonyms.Pseudonymizer(b"k"), pseudonyms.Pseudonymizer(b"k", back=True)

    def one(value):
        new, n = p.text(f"see {value} here")
        assert n == 1 and q.text(new) == (f"see {value} here", 1)
        return new[4:-5]

    for y, m, d in DATES:
        found = set()
        for text, order in ((f"{y}-{m:02d}-{d:02d}", "ymd"), (f"{y}/{m}/{d}", "ymd"), (f"{d:02d}.{m:02d}.{y}", "dmy"), (f"{d}/{m}/{y}", "dmy"), *([(f"{m}/{d}/{y}", "mdy"), (f"{m:02d}-{d:02d}-{y}", "mdy")] if d > 12 else [])):
            parts = dict(zip(order, map(int, re.split(r"[-/.]", one(text))), strict=True))
            found.add((parts["y"], parts["m"], parts["d"]))
        assert len(found) == 1 and found != {(y, m, d)}
    for spellings in (("+1 988 555 2485", "+19885552485", "+1 (988) 555-2485", "+1-988-555-2485"), ("+44 20 7946 0958", "+442079460958", "+44-20-7946-0958"), ("4041894974608795", "4041 8949 7460 8795", "4041-8949-7460-8795"), ("GB82WEST12345698765432", "GB82 WEST 1234 5698 7654 32")):
        assert len({re.sub(r"[^0-9A-Z]", "", one(x)) for x in spellings}) == 1
    assert one("(988) 555-2485")[1:4] + one("988-555-2485")[4:] == one("+1 988 555 2485")[3:6] + "-".join(one("+1 988 555 2485")[7:].split()).replace("-", "-", 1)
    assert one("Ann.Lee@Mail.org").lower() == one("ann.lee@mail.org") and one("a@b.co") != one("b@b.co")
    codes = {one(f"{chr(97 + i)}@b.co")[0] for i in range(26)}
    assert len(codes) == 26


@pytest.mark.parametrize("kind, values", [("date", ["%04d-%02d-%02d" % (2000 + i // 300, 1 + i % 12, 1 + i % 28) for i in range(900)]), ("ssn", [f"{100 + i}-{1 + i % 98:02d}-{1 + 7 * i % 9998:04d}" for i in range(600)])])
def test_pseudonyms_are_permutations(kind, values):
    p = pseudonyms.Pseudonymizer(b"k")
    distinct = sorted(set(values))
    assert len({p.text(v)[0] for v in distinct}) == len(distinct)


def test_pseudonyms_leave_clean_texts_alone():
    p = pseudonyms.Pseudonymizer(b"k")
    for text in ("version 3.10.2.1", "release 10.0.0.1 is out", "v1.2.3.4", "pages 100-200-300", "a..b@c.org", "x@-c.org", "1234567890123", "2021-13-40", "31/02/2020", "+1 23", "ISBN 978-3-16-148410-0", "call 5551234", "1.2.3", "@name", "3.14159", "10:30:45"):
        assert p.text(text) == (text, 0), text


def test_segmentation_against_all_segmentations():
    v = segmentation.pieces(segmentation.TOKENIZER)
    known = {name.decode().replace(" ", "▁"): i for i, name in enumerate(v.bytes) if i > 258 and name}

    def every(text, at, log_p):
        if at == len(text):
            yield (), log_p
        for n in range(1, 17):
            if text[at : at + n] in known and at + n <= len(text):
                i = known[text[at : at + n]]
                yield from (((i, *rest), p) for rest, p in every(text, at + n, log_p + v.log_p[i]))

    texts = ["a", "on it", "the", "under"]
    for d, _, ids, log_p, _ in segmentation._run(v, texts, segmentation.mixed(np.arange(len(texts), dtype=np.uint64)), 50):
        exact = dict(every("▁" + texts[d].replace(" ", "▁"), 0, 0.0))
        total = np.logaddexp.reduce(list(exact.values()))
        assert log_p == pytest.approx(exact[tuple(ids.tolist())] - total, abs=1e-3)
    counted: dict[int, set] = {}
    for d, _, ids, *_ in segmentation._run(v, texts, segmentation.mixed(np.arange(len(texts), dtype=np.uint64)), 50):
        counted.setdefault(d, set()).add(tuple(ids.tolist()))
    for d, text in enumerate(texts):
        exact = dict(every("▁" + text.replace(" ", "▁"), 0, 0.0))
        assert len(counted[d]) == min(50, len(exact)) and counted[d] <= set(exact)


def test_a_long_text_without_spaces_takes_linear_time():
    import time

    v, seconds = segmentation.pieces(segmentation.TOKENIZER), []
    r = random.Random(3)
    for n in (20_000, 80_000):
        text = "".join(r.choice("etaoinshrdlu") for _ in range(n))
        began = time.process_time()
        got = list(segmentation._run(v, [text], segmentation.mixed(np.arange(1, dtype=np.uint64)), 1))
        seconds.append(time.process_time() - began)
        assert segmentation.decode(got[0][2].tolist()) == text
    assert seconds[1] < 8 * seconds[0] + 1


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randint(0, 400), r.randint(0, 400)) for _ in range(300)] + [(500, k) for k in range(501, 900)] + [(k, k + 1) for k in range(1000, 1200)] + [(7, 7)]
    label = {n: n for e in edges for n in e if e[0] != e[1]}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    got = {x.node: x.component for x in components.components(Scratch(spark, "test"), df, "a", "b").collect()}
    assert got == label
    assert components.components(Scratch(spark, "test"), df.where("false"), "a", "b").count() == 0


def test_clashing_columns_and_a_join_instead_of_a_filter(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "MOST_MEMBERS", 0)
    base = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, base), (2, base + " x"), (3, None), (4, ""), (5, "other words here")], "doc_id long, text string")
    docs = docs.withColumns({c: F.lit(7) for c in ("gone", "GONE_", "component_id", "kept", "doc", "band", "salt", "u")})
    assert sorted(x.doc_id for x in near_dedup.deduplicated(docs).collect()) == [1, 3, 4, 5]
    assert near_dedup.deduplicated(docs).columns == docs.columns
    assert toxicity.accepted(docs, toxicity.DEFAULT).columns == docs.columns and pseudonyms.with_pseudonyms(docs, b"k").columns == docs.columns
    bench = spark.createDataFrame([(1, "other words here")], "item_id long, text string")
    assert sorted(x.doc_id for x in decontamination.uncontaminated(docs, bench).collect()) == [1, 2, 3, 4]
