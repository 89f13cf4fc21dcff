from brute import taken

from modlens.llm import mixing


def run(frame, **options):
    sizes = mixing.document_sizes(frame)
    targets = mixing.source_targets(sizes)
    mixed = mixing.mix(sizes, targets, **options)
    return mixed, mixing.taken_words(sizes, targets, mixed)


def rows_of(frame):
    return sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in frame.collect()), key=str)


def test_mix_takes_its_targets(docs):
    rows = [(k, "w " * (k * 7 % 90), f"s{k % 4}" if k % 9 else None) for k in range(150)]
    rows += [(500 + k, "x " * 3000, "s2") for k in range(5)] + [(900, None, "s1"), (901, "", "s7"), (902, "tiny", "z")]
    mixed, done = run(docs(rows), block_words=64)
    want = [(i, n, s, round(t, 6), w) for i, n, s, t, w in taken(rows)]
    assert rows_of(done) == sorted(want, key=str)
    slots = mixed.select("position", "source", "block").distinct().collect()
    assert len({s.position for s in slots}) == len(slots)
    # Any beginning of the schedule has each source near its share.
    goal = {r.source: r.target for r in done.select("source", "target").distinct().collect()}
    for n in (50, 200, len(slots) // 2):
        first = [s.source for s in sorted(slots)[:n]]
        for source, target in goal.items():
            assert abs(first.count(source) - n * target / sum(goal.values())) < 6
    assert rows_of(run(docs(rows, 5), block_words=64)[1]) == rows_of(done)


def test_repeated_rows_and_hostile_tables(docs):
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (2, "d", None), (None, "e f", None)]
    done = run(docs(rows))[1].collect()
    assert sum(r.taken for r in done if r.doc_id == 1) == 3  # weight 1 of 3, 9 words in all
    assert sum(r.taken for r in done if r.source is None) == 6 and len(done) == 4
    assert run(docs([]))[1].collect() == []
    assert [r.taken for r in run(docs([(1, None, "a"), (2, " ", "b")]))[1].collect()] == [0, 0]
    assert [(r.taken, r.target) for r in run(docs([(1, "one", "a")]))[1].collect()] == [(1, 1.0)]
