import random
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from assayer.llm import packing


def check(lengths, caps, bins, offsets, sizes):
    held = defaultdict(list)
    for n, b, o, c in zip(lengths, bins, offsets, sizes, strict=True):
        held[b].append((o, n, c))
    for parts in held.values():
        parts.sort()
        assert len({c for _, _, c in parts}) == 1
        end = 0
        for o, n, _ in parts:
            assert o == end
            end = o + n
        assert parts[0][2] == min(c for c in caps if c >= end)  # downsized
    return sum(p[0][2] for p in held.values())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_bins_hold_their_pieces(lengths):
    check(lengths, (16, 32, 64), *packing.pack(lengths, (16, 32, 64)))


def price_of(c):
    return 2 + c + c * c / 32


def total(lengths, caps, made):
    check(lengths, caps, *made)
    return sum(price_of(c) for _, c in {(b, c) for b, c in zip(made[0], made[2], strict=True)})


def cheapest(lengths, caps):
    """The least cost of any packing: every way to put the pieces into bins."""
    best = [float("inf")]

    def place(i, bins):
        if i == len(lengths):
            best[0] = min(best[0], sum(price_of(min(c for c in caps if c >= b)) for b in bins))
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= max(caps):
                place(i + 1, [b + lengths[i] * (j == k) for j, b in enumerate(bins)])
        place(i + 1, [*bins, lengths[i]])

    place(0, [])
    return best[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 32), min_size=1, max_size=7))
def test_near_the_cheapest_packing(lengths):
    caps = (8, 16, 32)
    made = total(lengths, caps, packing.pack(lengths, caps, price_of))
    assert cheapest(lengths, caps) - 1e-9 <= made <= 1.4 * cheapest(lengths, caps) + 1e-9


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 32), min_size=1, max_size=80))
def test_never_worse_than_one_length(lengths):
    caps = (8, 16, 32)
    made = total(lengths, caps, packing.pack(lengths, caps, price_of))
    for one in caps:
        if one >= max(lengths):
            bins, offsets, _ = packing.pack(lengths, (one,), price_of)
            full = defaultdict(int)
            for n, b in zip(lengths, bins, strict=True):
                full[b] += n
            shrunk = [min(c for c in caps if c >= full[b]) for b in bins]
            assert made <= total(lengths, caps, (bins, offsets, shrunk)) + 1e-9


def test_lengths_are_chosen_jointly():
    rng = random.Random(3)
    lengths = [min(4096, int(rng.lognormvariate(5.5, 1)) + 1) for _ in range(5000)]
    bins, offsets, sizes = packing.pack(lengths)
    assert check(lengths, packing.CAPACITIES, bins, offsets, sizes) <= 1.1 * sum(lengths)
    used = Counter(dict(zip(bins, sizes, strict=True)).values())
    assert len(used) >= 3 and all(used[c] > 20 for c in (512, 1024, 2048))
    price = lambda made: sum(packing.cost(c) for c in dict(zip(made[0], made[2], strict=True)).values())
    assert price((bins, offsets, sizes)) < 0.8 * price(packing.pack(lengths, (4096,)))


def test_tokens_are_those_of_the_token_store(documents):
    from assayer.llm import queries, token_store

    path = queries.vocabulary()
    held = {r.doc_id: len(r.ids) // 2 for r in token_store.encoded(documents.select("doc_id", "text"), path).collect()}
    got = defaultdict(int)
    for r in packing.digest(documents, path).collect():
        got[r.doc_id] += r.n_tokens
        assert r.position + r.n_tokens <= r.capacity
    assert got == held


def test_whole_texts_are_packed(documents, empty, odd):
    rows = packing.best_fit(documents, capacities=(64, 128, 256)).collect()
    spans = defaultdict(list)
    bins = defaultdict(list)
    for r in rows:
        spans[r.doc_id].append((r.start, r.n_tokens))
        bins[r.sequence_id].append((r.position, r.n_tokens, r.capacity))
    for d in documents.collect():
        end = 0
        for start, n in sorted(spans.pop(d.doc_id)):
            assert start == end and n <= 256
            end += n
        assert end == len((d.text or "").split()) + 1
    assert not spans
    for parts in bins.values():
        parts.sort()
        end = 0
        for o, n, c in parts:
            assert o == end
            end += n
        assert end <= parts[0][2]
    assert packing.digest(empty).count() == 0
    assert packing.digest(odd).count() == odd.count()
    assert sorted(packing.digest(documents).collect()) == sorted(packing.digest(documents.repartition(3)).collect())


def test_blocks_are_bounded(spark):
    rows = spark.range(1000).selectExpr("5L as doc_id", "0 as piece", "0L as start", "7L as n_tokens")
    got = packing.pack_pieces(rows, (16, 32), block=64).collect()
    assert len(got) == 1000
    sizes = defaultdict(int)
    for r in got:
        sizes[r.sequence_id.rsplit("-", 1)[0]] += 1
    assert max(sizes.values()) == 64 and len(sizes) == 16


def test_ordered_blocks_are_runs_of_rows(spark):
    docs = spark.range(600).repartition(1).sortWithinPartitions("id").selectExpr("id as doc_id", "'a b c' as text")
    rows = packing.pack_pieces(packing.pieces(docs), (16, 32), block=100, ordered=True).collect()
    blocks = defaultdict(list)
    for r in rows:
        blocks[r.sequence_id.rsplit("-", 1)[0]].append(r.doc_id)
    assert len(rows) == 600 and sorted(sorted(b) for b in blocks.values()) == [list(range(a, a + 100)) for a in range(0, 600, 100)]


def test_one_worker_encodes_and_packs_rows_as_they_stand(documents, odd, empty):
    from assayer.llm import queries

    path, caps = queries.vocabulary(), (64, 128, 256)
    for docs in (documents.repartition(3).select("doc_id", "text").localCheckpoint(), odd, empty):
        one = packing.best_fit(docs, capacities=caps, tokenizer=path, ordered=True)
        two = packing.pack_pieces(packing.pieces(docs, longest=256, tokenizer=path), caps, ordered=True)
        assert one.schema == two.schema
        assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
        assert one._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_batches_of_the_reader_are_small(spark, documents):
    from assayer.llm import common

    common.small_batches(spark)
    assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= common.BATCH_ROWS
