"""Operators against brute force over the awkward documents, and on empty tables."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ponderlake.llm import components, exact_dedup, lm_scoring, mixing, near_dedup, pieces, pii, quality_classifier, quality_rules, queries, substring_dedup, textops, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
fold_case = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall(t or "")


def table(df, key="doc_id"):
    out = collections.defaultdict(list)
    for r in df.collect():
        out[r[key]].append(r)
    return out


def test_kernel_words_and_windows():
    texts = ["a b  c\n", "", "x", " lead", " ", "éà bb", "q" * 9000 + " z"]
    raw = [t.encode() for t in texts]
    b = textops.Block(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
    assert [b.word(i).decode() for i in range(len(b.start))] == [w for t in texts for w in words(t)]
    assert b.counts.tolist() == [len(words(t)) for t in texts]
    h = np.array([3, 1, 4, 1, 5, 3, 1, 4, 1, 5], np.uint64)
    for k in range(1, 6):
        w = textops.windows(h, k)
        assert w[0] == w[5] and len(set(w[:5].tolist())) == (4 if k == 1 else 5)


# SentencePiece


def test_pieces_equal_library(spark, docs, rows):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=queries.model_path())
    got = table(pieces.round_trip(docs, queries.model_path()))
    for i, t, *_ in rows:
        ids = lib.encode(t or "")
        for r in got[i]:
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids)))
    assert sum(map(len, got.values())) == len(rows)
    e = pieces.encode(docs, queries.model_path())
    back = table(pieces.decode(e, queries.model_path()))
    assert all(back[i][0].text == lib.decode(lib.encode(t or "")) for i, t, *_ in rows)


def test_pieces_random_strings():
    import random

    import sentencepiece

    lib, m, rng = sentencepiece.SentencePieceProcessor(model_file=queries.model_path()), pieces.pieces(queries.model_path()), random.Random(1)
    alphabet = ["a", "b", "e", "the", "ing", " ", "  ", "\n", "é", "日", "👩", "\t", ".", "1", "▁", "́", " " * 40, "\x00", "<s>"]
    cases = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    ids, count = m.encode(cases)
    decoded, at = m.decode(ids, count), np.concatenate([[0], np.cumsum(count)])
    for i, x in enumerate(cases):
        want = lib.encode(x)
        assert ids[at[i] : at[i + 1]].tolist() == want and decoded[i] == lib.decode(want).encode()
    for _ in range(500):  # byte pieces in any order
        some = [rng.choice([259 + rng.randint(0, 40), 3 + rng.randint(0, 255)]) for _ in range(rng.randint(1, 8))]
        assert m.decode(np.array(some, np.int32), np.array([len(some)]))[0] == lib.decode(some).encode()


# exact dedup


def test_exact_dedup(docs, rows):
    groups = collections.defaultdict(list)
    for i, t, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    for bits in (26, 4):  # a filter that is full lets all through
        got = table(exact_dedup.exact_dedup(docs, filter_bits=bits))
        assert sum(map(len, got.values())) == len(rows)
        for key, members in groups.items():
            keep = min(members)[1]
            for _, i in members:
                assert {(r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got[i]} == {(keep, len(members), i == keep, sha(key))}


# near dedup


def shingle_set(t):
    w = words((t or "").translate(fold_case))
    return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def reach(rows):
    sets = {i: shingle_set(t) for i, t, *_ in rows}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_dedup(docs, rows):
    got, want = table(near_dedup.near_dedup(docs)), reach(rows)
    assert sum(map(len, got.values())) == len(rows)
    for i, (n, c) in want.items():
        assert {(r.n_shingles, r.component_id, r.kept) for r in got[i]} == {(n, c, c == i)}


def test_near_dedup_chain_and_family(spark):
    """A chain whose ends aren't near, and a family around a common passage that mostly isn't near."""
    import random

    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(900)]
    t, rows = [rng.choice(vocabulary) for _ in range(150)], []
    for i in range(12):
        rows.append((i, " ".join(t)))
        t = t[:]
        at = rng.randrange(0, 140)
        t[at : at + 6] = [rng.choice(vocabulary) for _ in range(6)]
    passage = [rng.choice(vocabulary) for _ in range(80)]
    rows += [(100 + i, " ".join(passage + [rng.choice(vocabulary) for _ in range(rng.randint(0, 40))])) for i in range(60)]
    rows += [(300 + i, " ".join(rng.choice(vocabulary[:3]) for _ in range(rng.randint(5, 8)))) for i in range(60)]
    got = table(near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)))
    for i, (n, c) in reach(rows).items():
        assert (got[i][0].n_shingles, got[i][0].component_id) == (n, c)


def test_registers_and_estimate():
    r = np.random.default_rng(2)
    base = r.integers(0, 2**63, 4000).astype(np.uint64) * np.uint64(2)
    for share in (0.3, 0.75, 1.0):
        n = 2000
        both = int(2 * n * share / (1 + share))
        a, b = np.unique(base[:n]), np.unique(base[n - both : 2 * n - both])
        ra, rb = near_dedup.registers(a)[None], near_dedup.registers(b)[None]
        est, used = near_dedup.similarity(ra, rb, np.array([n]), np.array([n]))
        assert abs(est[0] - share) < 0.13 and used[0] > 250
        assert share < 0.75 or near_dedup._near(est, used, np.array([n]), np.array([n]))[0]
    one = near_dedup.dense(near_dedup.registers(np.array([5], np.uint64))[None])
    assert len(set(one[0].tolist())) == 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 50), (100, 60), (7, 7), (60, 61)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and {got[i] for i in (50, 60, 61, 100)} == {50} and len(got) == 45


# substring dedup


def test_substring_dedup(docs, rows):
    first = {}
    for i, t, *_ in rows:
        w = words(t)
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            first[g] = min(i, first.get(g, i))
    got = table(substring_dedup.substring_dedup(docs))
    assert sum(map(len, got.values())) == len(rows)
    removed = 0
    for i, t, *_ in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        removed += sum(gone)
        want = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
        assert {(r.n_words, r.n_removed, r.kept_sha256) for r in got[i]} == {want}
    assert removed > 6000


# language model


def test_lm_scores(docs, rows):
    tokens = [(i, words((t or "").translate(fold_case)) + [None]) for i, t, *_ in rows]
    rest = lambda i: zlib.crc32(str(i).encode()) % 10
    count = collections.Counter(x for i, w in tokens if rest(i) for x in w)
    n, types = sum(count.values()), len(count)
    got = table(lm_scoring.lm_scores(docs))
    assert sum(map(len, got.values())) == len(rows)
    for i, w in tokens:
        for r in got[i]:
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (rest(i) == 0, len(w), sum(count[x] > 0 for x in w), n)
            assert r.base_score == pytest.approx(sum(math.log10((count[x] + 0.1) / (n + 0.1 * (types + 1))) for x in w), rel=1e-9)
            assert math.isfinite(r.score) and r.score < 0


def test_lm_model_against_brute_force(docs, rows):
    """The mixture itself, with the weights that the fit gives, worked out token by token."""
    rest = lambda i: zlib.crc32(str(i).encode()) % 10
    tokens = [(i, words((t or "").translate(fold_case)) + ["</s>"]) for i, t, *_ in rows]

    def counts(keep):
        one, two = collections.Counter(), collections.Counter()
        for i, w in tokens:
            if keep(rest(i)):
                one.update(w)
                two.update(zip(["<s>", *w], w, strict=False))
                one["<s>"] += 1
        return one, two, sum(v for k, v in one.items() if k != "<s>"), len([k for k in one if k != "<s>"])

    bucket = lambda c: min(math.ceil(math.log2(c + 1)), lm_scoring.FREQUENCIES - 1)
    one, two, n, types = counts(lambda r: r not in (0, lm_scoring.DEV))
    cells = collections.Counter()
    step = lambda p: round(-lm_scoring.STEP * math.log2(p)) if p else -1
    for i, w in tokens:
        if rest(i) == lm_scoring.DEV:
            for v, x in zip(["<s>", *w], w, strict=False):
                cells[bucket(one[v]) << 40 | (step(two[v, x] / max(one[v], 1)) + 1) << 20 | (step(one[x] / n) + 1)] += 1
    weights = lm_scoring.fit_weights(np.array(list(cells), np.int64), np.array(list(cells.values()), float), types)
    assert np.allclose(weights.sum(1), 1)
    one, two, n, types = counts(lambda r: r != 0)
    got = table(lm_scoring.lm_scores(docs))
    for i, w in tokens:
        score = 0.0
        for v, x in zip(["<s>", *w], w, strict=False):
            l0, l1, l2 = weights[bucket(one[v])]
            score += math.log10(l0 / (types + 1) + l1 * one[x] / n + l2 * two[v, x] / max(one[v], 1))
        assert got[i][0].score == pytest.approx(score, rel=1e-6)


# rules


def test_rules(docs, rows):
    led = quality_rules.apply_policy(quality_rules.ledger(docs)).cache()
    got = table(led)
    for i, t, *_ in rows:
        w, t = words(t), t or ""
        lines, seen, dup = t.split("\n"), set(), 0
        for x in lines:
            dup += x in seen and bool(words(x))
            seen.add(x)
        grams = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w))
        for r in got[i]:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
            assert not (r.kept and r.base_failed)
    a = {r.rule: (r.n_failed, r.n_only) for r in quality_rules.ablations(led).collect()}
    all_rows = [r for rs in got.values() for r in rs]
    for rule, bit in quality_rules.BITS.items():
        if bit & quality_rules.POLICIES["v1"]:
            assert a[rule] == (sum(bool(r.failed & bit) for r in all_rows), sum((r.failed & quality_rules.POLICIES["v1"]) == bit for r in all_rows))


# mixing


def water(sizes, weights, cap):
    """Resharing in rounds, as the rule is told."""
    total, target, capped = sum(sizes), [0.0] * len(sizes), set()
    while len(capped) < len(sizes):
        left = total - sum(target[i] for i in capped)
        free = [i for i in range(len(sizes)) if i not in capped]
        for i in free:
            target[i] = left * weights[i] / sum(weights[j] for j in free)
        over = [i for i in free if target[i] > cap * sizes[i]]
        if not over:
            break
        for i in over:
            target[i] = float(cap * sizes[i])
            capped.add(i)
    return target


def test_mixing(docs, rows):
    sizes = collections.defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len(words(t))
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    want = dict(zip(names, water([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 3), strict=True))
    m = mixing.mix(docs)
    source = {i: s for i, _, _, s in rows}
    taken = collections.defaultdict(int)
    for r in m.collect():
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 3 * r["size"]
        taken[s] += r.taken
    longest = collections.defaultdict(int)
    for _, t, _, s in rows:
        longest[s] = max(longest[s], len(words(t)))
    assert all(abs(taken[s] - want[s]) <= longest[s] / 2 + 0.5 for s in names)
    assert all(r.taken % r["size"] == 0 for r in m.collect() if r["size"])
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    assert sorted(map(repr, m.collect())) == sorted(map(repr, mixing.mix(docs).collect()))


def test_training_order(docs, rows):
    o = mixing.training_order(docs.dropDuplicates(["doc_id"]))
    assert o.columns == docs.columns
    got = collections.Counter()
    for r in o.collect():
        got[r.source] += len(words(r.text))
    m = collections.Counter()
    for r in mixing.mix(docs.dropDuplicates(["doc_id"])).collect():
        m[{i: s for i, _, _, s in rows}[r.doc_id]] += r.taken
    assert got == +m


def test_training_order_keeps_white_space(spark):
    rows = [(i, "\n  " + "\n\n".join(f"w{i}\t a   b" for _ in range(9 + i)) + " \n", "en", f"s{i % 3}") for i in range(12)]
    o = mixing.training_order(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    whole = {i: t for i, t, *_ in rows}
    assert o and all(r.text == whole[r.doc_id] for r in o)


def test_mixing_query_is_in_order(spark):
    at = [r.position for r in queries.op4_mixing(spark, "/root/testdata/sf0.001").collect()]
    some = [x for x in at if x is not None]
    assert some == sorted(some) == at[: len(some)]


# personal data


def test_pii(spark):
    rows = [
        (1, "Card 4111111111111111 and 4111-1111-1111-1111, no card 4111111111111112. a.b@x.example.com! +1 (907) 555-1190 or 907-555-1190"),
        (2, "ip 25.63.122.242 not 256.1.1.1; 2024-02-29 not 2023-02-29, 31.12.1999, 12/25/1976; 123-45-6789 not 000-12-3456"),
        (3, 'password=f0b4e711f4353f8e01 token = "d8eb2888fc1a1ec9e3a8f1bd23ba5a9fda51422d"'), (4, None), (5, ""), (6, "plain"), (7, "4111111111111111 25.63.122.242 2024-02-29"),
    ]
    got = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    luhn = lambda d: sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0
    one = got[1].text
    cards = [re.sub("-", "", x) for x in re.findall(r"4\d{3}-?\d{4}-?\d{4}-?\d{4}", one)]
    assert cards[0] == cards[1] != "4111111111111111" and luhn(cards[0]) and cards[2] == "4111111111111112" and "x.example.com" not in one
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4} or \d{3}-\d{3}-\d{4}$", one) and "555-1190" not in one
    two = got[2].text
    assert "256.1.1.1" in two and "2023-02-29" in two and "000-12-3456" in two and not any(x in two for x in ("25.63.122.242", "2024-02-29", "31.12.1999", "12/25/1976", "123-45-6789"))
    assert (got[2].n_ip, got[2].n_date, got[2].n_ssn, got[3].n_secret) == (1, 3, 1, 2) and "f0b4" not in got[3].text and "d8eb" not in got[3].text
    assert [got[i].text for i in (4, 5, 6)] == [None, "", "plain"] and got[4].n_found == 0
    assert got[7].text.split()[0] == cards[0] and got[7].text.split()[1] in two and got[7].text.split()[2] in two


def test_pii_card_groups(spark):
    """Grouped and plain forms of every length have equal pseudonyms; what follows a card stays."""
    forms = ["3056 930902 5904", "3782-822463-10005", "4222 2222 2222 2", "6304 0000 0000 0000 000", "6304 0000 0000 0000 00", "6304 0000 0000 0000 0", "4111 1111 1111 1111"]
    luhn = lambda d: sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0

    def right(x):  # the check digit made right
        return next(x[:-1] + c for c in "0123456789" if luhn(re.sub("[ -]", "", x[:-1] + c)))

    forms = [right(x) for x in forms]
    texts = [f"a {x} b {re.sub('[ -]', '', x)} c" for x in forms]
    texts += ["4111 1111 1111 1111 123", "4111 1111 1111 1111 12/27", "4111 1111 1111 1111 907 555 1190", "1234 930902 5905", "4111 1111 1111 1111"]
    got = [r.text for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    for x, t in zip(forms, got):
        one, two = re.fullmatch(r"a (.*) b (\d+) c", t).groups()
        assert re.sub(r"\d", "9", one) == re.sub(r"\d", "9", x) and re.sub("[ -]", "", one) == two != re.sub("[ -]", "", x) and luhn(two)
    cvv, date, phone, no_card, card = got[len(forms):]
    assert card != "4111 1111 1111 1111" and cvv == f"{card} 123" and date == f"{card} 12/27"
    assert phone.startswith(f"{card} ") and "555 1190" not in phone and no_card.startswith("1234 ") and "930902 5905" not in no_card


def test_feistel_is_a_permutation(spark):
    n = spark.range(1000).select(F.expr(pii._network("id", "10", "100", "t", "k")).alias("x"), F.expr(pii._walk("id", "10", "100", "t", "k", lambda v: f"({v} < 400)")).alias("y"), "id")
    rows = n.collect()
    assert sorted(r.x for r in rows) == list(range(1000)) == sorted(r.y for r in rows)
    assert all((r.y < 400) == (r.id < 400) for r in rows)
    days = spark.sql("SELECT date_add(date'2023-01-01', cast(id AS int)) AS d, id FROM range(800)").select("id", F.date_format("d", "yyyy-MM-dd").alias("d"))
    got = pii.pseudonymise(days.selectExpr("id AS doc_id", "d AS text"), "k").collect()
    assert len({r.text for r in got}) == 800 and all(r.n_date == 1 and 1900 <= int(r.text[:4]) <= 2099 for r in got)


# classifiers


def labelled(spark):
    import random

    rng = random.Random(3)
    good = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(20, 60)))
    rows, labels = [], []
    for i in range(400):
        t, bad, mean = good(), i % 8 == 0, i % 5 == 0
        if bad:
            t = " | ".join(t.split())
        if mean:
            w = t.split()
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["stupid", "idiot", "grubloxa", "grubloxi", "grubloxu"]))
            t = " ".join(w)
        rows.append((i, t))
        labels.append((i, int(not bad), int(mean)))
    rows += [(1000, None), (1001, ""), (1002, " \n")]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, labels[0], (5000, 1, 1), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int"), {i: (q, x) for i, q, x in labels}


def test_importance_resampling(spark):
    docs, labels, truth = labelled(spark)
    got = table(quality_classifier.resample(docs, labels))
    good = [got[i][0].kept for i, (q, _) in truth.items() if q]
    bad = [got[i][0].kept for i, (q, _) in truth.items() if not q]
    assert all(good) and sum(bad) <= 6 and got[1001][0].log_weight == 0
    kept = {r.doc_id for r in quality_classifier.keep_good(docs, labels).collect()}
    assert kept == {i for i, r in got.items() if r[0].kept}
    assert all(r[0].kept for r in table(quality_classifier.resample(docs, labels.limit(0))).values())


def test_kth_largest(spark):
    import random

    rng = random.Random(8)
    x = [rng.gauss(0, 1) for _ in range(20000)] + [5.0] * 9000
    df = spark.createDataFrame([(v,) for v in x], "key double")
    for k in (1, 9000, 9001, 15000, 28999):
        assert quality_classifier.kth_largest(df, k, len(x)) == sorted(x, reverse=True)[k - 1]


def test_toxicity_learns(spark):
    docs, labels, truth = labelled(spark)
    got = table(toxicity.toxicity(docs, labels))
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i][0].held_out for i in held)
    right = sum(got[i][0].predicted == truth[i][1] for i in held)
    assert right >= 0.95 * len(held)
    assert all(0 <= r[0].score <= 1 and r[0].predicted == int(r[0].score >= 0.7) for r in got.values()) and got[1000][0].score == got[1001][0].score == 0


def test_toxicity_gradients():
    """Backpropagation against differences."""
    texts = ["alpha beta gamma stupid delta", "one two three"]
    b = toxicity._block(texts)
    net = toxicity.Network(np.unique(b.hashes()))
    net.p = {k: x.astype(np.float64) for k, x in net.p.items()}
    w = toxicity.Words(b)
    d, at, size = toxicity.window_starts(b.counts)
    index = toxicity._index(b, w.of, d, at)

    def loss():
        x, _ = net.inputs(w)
        return float((net.forward(x.astype(np.float64), index, size) * np.array([1.0, -2.0])).sum())

    x, ids = net.inputs(w)
    s = {}
    net.forward(x.astype(np.float64), index, size, s)
    g = net.backward(s, np.array([1.0, -2.0]), w, ids)
    r = np.random.default_rng(1)
    for name in ("uf", "wb", "att", "v", "out", "bias", "bf", "word", "char"):
        flat, gf = net.p[name].reshape(-1), np.asarray(g[name], float).reshape(-1)
        for j in r.choice(np.flatnonzero(np.abs(gf) > 1e-9), 4):
            old, eps = flat[j], 1e-3
            flat[j] = old + eps
            up = loss()
            flat[j] = old - eps
            down = loss()
            flat[j] = old
            assert (up - down) / (2 * eps) == pytest.approx(gf[j], rel=0.05, abs=2e-3)


def test_windows_cover_every_word():
    count = np.array([0, 1, 31, 32, 33, 48, 49, 1000])
    d, at, size = toxicity.window_starts(count)
    for i, n in enumerate(count):
        seen = set()
        for a, s in zip(at[d == i], size[d == i], strict=True):
            seen |= set(range(a, a + s))
        assert seen == set(range(n))


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for f in (exact_dedup.exact_dedup, near_dedup.near_dedup, substring_dedup.substring_dedup, mixing.mix, mixing.training_order, quality_rules.ledger, lambda d: pii.pseudonymise(d, "k"), lm_scoring.lm_scores):
        assert f(empty).count() == 0
    for f in (quality_classifier.resample, quality_classifier.keep_good, toxicity.toxicity):
        assert f(empty, labels).count() == 0
    assert pieces.round_trip(empty, queries.model_path()).count() == 0
    assert pieces.tokenise(empty, queries.model_path()).count() == 0


def test_null_ids(spark, rows):
    df = spark.createDataFrame([(None, rows[0][1], "en", "s1"), (None, None, None, None), *rows[:12]], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for f in (exact_dedup.exact_dedup, near_dedup.near_dedup, substring_dedup.substring_dedup, mixing.mix, quality_rules.ledger, lambda d: pii.pseudonymise(d, "k"), lm_scoring.lm_scores, lambda d: pieces.round_trip(d, queries.model_path())):
        assert f(df).count() == 14
    assert quality_classifier.resample(df, labels).count() == 14 and toxicity.toxicity(df, labels).count() == 14


def test_pieces_that_span_segments_are_refused(monkeypatch):
    import sentencepiece

    class Spanning(sentencepiece.SentencePieceProcessor):
        def id_to_piece(self, i):
            return "a▁b" if i == 5000 else super().id_to_piece(i)

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Spanning)
    with pytest.raises(ValueError, match="span segments"):
        pieces.Pieces(queries.model_path())


def test_pieces_clashing_columns_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a  b\n", "x", "y"), (1, "a  b\n", "x", "y"), (None, None, "x", "y")], "doc_id long, text string, ids string, n_tokens string")
    got = pieces.round_trip(df, queries.model_path()).collect()
    assert len(got) == 3 and len({r.ids_sha256 for r in got if r.doc_id == 1}) == 1 and [r.n_tokens for r in got if r.doc_id is None] == [0]
