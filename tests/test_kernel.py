import random
import time
import tracemalloc

import numpy as np
import pytest

from strandloom.config import AlignConfig
from strandloom.operators import kernel
from strandloom.operators.kernel import Chain, Recent, Task, Window, align, align_many, drawn, place_many, scored
from tests import scalar_alignment as scalar

REF = "GCTAAAGACAATTACATAACATACACGTCAGCACGAAACTTGTTGGCC" + "CAGTGTGAATCGCTTAAGGGTTAAGTAAGTGT"
L = REF[8:28]


def same(got, want):
    if got is None or want is None:
        return got is want
    return (got.position, got.mismatches, sorted(got.indels)) == (want[0], want[1], sorted(want[2]))


def changed(rng, text, letters):
    out = []
    for c in text:
        x = rng.random()
        if x < 0.06:
            out.append(rng.choice(letters))
        elif x < 0.1:
            out += [c, *rng.choices(letters, k=rng.choice([1, 1, 2, 6]))]
        elif x > 0.05 + 0.9 * 1:
            continue
        else:
            out.append(c)
    return "".join(out)


def test_kernel_by_hand():
    ref = Window(REF, 0, len(REF))
    m = align(ref, "CAATTACATAACATAGACGT", 0, len(REF), 25)
    assert (m.position, m.mismatches, m.indels) == (8, {23: "G"}, [])
    assert align(ref, "ACG", 5, 3, 25) is None
    with pytest.raises(ValueError):
        align(ref, "ACG", 6, 3, 25)
    assert drawn(ref, L, align(ref, L, 0, 40, 25))[1].strip() == L


@pytest.mark.parametrize("letters", ["AC", "ACG", "ACGT"])
def test_mappings_equal_those_of_the_plain_version(letters):
    """Position, mismatches and indels, ties included; all windows of a case go through one call."""
    rng = random.Random(len(letters))
    for gap, tolerance in ((1, 4), (3, 4), (25, 4), (25, 0)):
        tasks, want = [], []
        for _ in range(150):
            ref = "".join(rng.choices(letters, k=rng.randint(1, 40)))
            a = rng.randint(0, len(ref) - 1)
            read = changed(rng, ref[a : a + rng.randint(1, 25)], letters) or "A"
            left = rng.randint(0, len(ref) - 1)
            right = rng.randint(left - 2, len(ref))
            tasks.append(Task(Window(ref, 0, len(ref)), read, left, right))
            want.append(scalar.align(ref, read, left, right, gap, tolerance) if right - left + 1 >= -1 else None)
        got = align_many([t for t in tasks if t.rows >= -1], gap, tolerance)
        assert all(same(g, w) for g, w in zip(got, [w for t, w in zip(tasks, want) if t.rows >= -1]))


def test_long_windows_equal_the_plain_version():
    rng = random.Random(11)
    for letters, gap in (("AC", 1), ("ACGT", 2), ("ACGT", 25), ("AB", 25)):
        ref = "".join(rng.choices(letters, k=900))
        ref = ref[:300] + ref[100:160] + ref[360:]
        reads = [changed(rng, ref[a : a + 14], letters) or "A" for a in rng.sample(range(880), 12)] + ["X" * 9]
        got = align_many([Task(Window(ref, 0, 900), r, 3, 900) for r in reads], gap)
        assert all(same(g, scalar.align(ref, r, 3, 900, gap)) for g, r in zip(got, reads))


def test_a_window_is_enough():
    """Only the part of the reference that a window covers is needed."""
    full, part = Window(REF, 0, len(REF)), Window(REF[20:60], 20, len(REF))
    assert align(full, "ACACGTCAGC", 22, 55, 25).row() == align(part, "ACACGTCAGC", 22, 55, 25).row()


def test_placed_chains_equal_the_plain_version():
    rng = random.Random(7)
    chains, want = [], []
    for _ in range(400):
        letters = rng.choice(["AC", "ACGT"])
        ref = "".join(rng.choices(letters, k=rng.randint(30, 90)))
        at = rng.randint(0, len(ref) - 25)
        read = changed(rng, ref[at : at + rng.randint(16, 30)], letters) or "ACGTACGTACGTACGTA"
        size = max(2, len(read) // rng.choice([1, 2, 3, 4]))
        tiles = [read[i : i + size] for i in range(0, len(read), size)]
        places = [ref.find(t) if rng.random() < 0.8 else -1 for t in tiles]
        if all(p < 0 for p in places):
            places[rng.randrange(len(places))] = rng.randint(0, len(ref) - 1)
        merged, kept = [], []
        for p, t in zip(places, tiles):  # neighbours without a place are one tile
            if merged and p < 0 and merged[-1] < 0:
                kept[-1] += t
            else:
                merged.append(p)
                kept.append(t)
        chains.append(Chain(Window(ref, 0, len(ref)), read, merged, kept))
        try:
            want.append((scalar.place(ref, read, merged, kept, 20), False))
        except ValueError:
            want.append((None, True))
    got = place_many(chains, 20, AlignConfig())
    assert [f for _, f in got] == [f for _, f in want] and sum(f for _, f in want) > 3
    assert all(same(g, w) for (g, _), (w, _) in zip(got, want))
    assert sum(w is not None for w, _ in want) > 100


def test_recent():
    rng = np.random.default_rng(1)
    for most in (1, 2, 3, 7, 25):
        recent, keys = Recent(most), rng.integers(0, 100, 80)
        for i, k in enumerate(keys):
            recent.add(np.array([k]))
            assert recent.best()[0] == keys[max(0, i - most + 1) : i + 1].max()


@pytest.mark.parametrize("gap", [126, 127, 128, 140, 200, 300])
def test_long_gaps(gap):
    """A deletion and an insertion of up to the greatest gap, between parts that are long enough to pay for it."""
    rng = random.Random(gap)
    ref = "".join(rng.choices("ACGT", k=1200))
    for size in (gap - 5, gap):
        lost = ref[100:400] + ref[400 + size : 700 + size]
        m = align(Window(ref, 0, 1200), lost, 0, 1200, gap)
        assert m.errors() == size and [t for t, _, _ in m.indels] == ["D"] and m.position == 100
        more = ref[100:400] + "".join(rng.choices("ACGT", k=size)) + ref[400:700]
        m = align(Window(ref, 0, 1200), more, 0, 1200, gap)
        assert m.position == 100 and sum(n for t, _, n in m.indels if t == "I") >= size - 5
    ref, read = ref[:330], ref[5:25] + ref[25 + gap - 90 : 45 + gap - 90]
    for left, right in ((0, 330), (0, 60)):
        assert same(align(Window(ref, 0, 330), read, left, right, gap), scalar.align(ref, read, left, right, gap))


def test_reads_that_fit_nowhere():
    """They are answered without a trace, and equal the plain version, short reads included."""
    rng = random.Random(2)
    ref = "".join(rng.choices("ACGT", k=700))
    for read in ("N" * 9, "N" * 2, "N", "NA", "AN", "NNANN", "A", "AC", "NNNNNNNNNNACG"):
        for left, right in ((0, 700), (3, 40), (7, 7)):
            assert same(align(Window(ref, 0, 700), read, left, right, 25), scalar.align(ref, read, left, right, 25)), (read, left, right)
    ref = "".join(rng.choices("ACGT", k=8000))
    began = time.time()
    align(Window(ref, 0, 8000), ref[50:100], 0, 8000, 25)
    plain, began = time.time() - began, time.time()
    assert align(Window(ref, 0, 8000), "N" * 50, 0, 8000, 25).position == -1
    assert time.time() - began < 2 * plain + 1


def test_letters_of_any_script_differ():
    ref = Window("αβγδεζηθικλμνξοπ", 0, 16)
    m = align(ref, "δεζωθικλ", 0, 16, 25)
    assert (m.position, m.mismatches) == (3, {6: "ω"})


def test_what_is_too_long_is_refused():
    with pytest.raises(ValueError):
        scored(np.zeros((1, 1 << 20), np.uint32), np.zeros((1, 3), np.uint32), 1, trace=False)


@pytest.mark.parametrize("letters", ["AC", "ACGT"])
def test_checkpoints_equal_tables(monkeypatch, letters):
    """With hardly any room for tables, every end is traced by checkpoints."""
    rng = random.Random(31)
    tasks = []
    for gap in (1, 3, 25, 140):
        for _ in range(25):
            ref = "".join(rng.choices(letters, k=rng.randint(1, 200)))
            a = rng.randint(0, len(ref) - 1)
            read = changed(rng, ref[a : a + rng.randint(1, 25)], letters) or "A"
            tasks.append((Task(Window(ref, 0, len(ref)), read, 0, len(ref)), gap))
    want = [align_many([t], g)[0] for t, g in tasks]
    monkeypatch.setattr(kernel, "BATCH", 1)
    seen = []
    monkeypatch.setattr(kernel, "Checkpoints", lambda *x, made=kernel.Checkpoints: seen.append(1) or made(*x))
    assert [align_many([t], g)[0] for t, g in tasks] == want and len(seen) >= len(tasks)


def test_a_long_read_needs_little_memory(monkeypatch):
    """A table for this read would take 3 MB of pointers."""
    monkeypatch.setattr(kernel, "BATCH", 1 << 18)
    rng = random.Random(32)
    ref = "".join(rng.choices("ACGT", k=2000))
    read = ref[200:900] + ref[901:1300] + "A" + ref[1301:1700]
    tracemalloc.start()
    m = align(Window(ref, 0, len(ref)), read, 0, len(ref), 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert m.position == 200 and [(t, n) for t, _, n in m.indels] == [("D", 1)] and len(m.mismatches) <= 1
    assert peak < 3 << 19, peak


def test_narrow_windows_equal_whole_ones(monkeypatch):
    """Windows cut down to where a whole piece of the read stands, at either end and beside repeats."""
    rng = random.Random(3)
    tasks = []
    for turn in range(40):
        ref = "".join(rng.choices("ACGT", k=rng.randint(150, 300)))
        ref = ref[:90] + ref[10:60] + ref[90:] if turn % 3 == 0 else ref
        at, k = rng.choice([0, 4, rng.randint(0, len(ref) - 60), len(ref) - 50]), rng.randint(0, 40)
        read = ref[at : at + 50]
        read = [read, read[:k] + "T" + read[k + 1 :], read[:k] + read[k + 1 :], read[:k] + "GA" + read[k:]][turn % 4]
        tasks.append(kernel.Task(kernel.Window(ref, 0, len(ref)), read, 0, len(ref)))
    assert sum(kernel.narrowed(t) is not None for t in tasks) > 20
    for gap in (1, 25):
        got = kernel.align_many(tasks, gap)
        with monkeypatch.context() as m:
            m.setattr(kernel, "narrowed", lambda t: None)
            assert got == kernel.align_many(tasks, gap)
