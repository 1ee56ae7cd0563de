"""Mixing, embeddings, paragraphs and the pipeline against plain versions."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from memlift.llm import embed_dedup, mixing, para_dedup


def targets(sizes):
    """Shares by weight 1, 2, 3, capped at three times the size, what is over going to the others."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    out, free, left = {}, set(names), sum(sizes.values())
    while free:
        w = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w > 3 * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / w for s in free}
        for s in over:
            out[s] = 3 * sizes[s]
        left -= sum(out[s] for s in over)
        free -= set(over)
    return out


class TestMixing:
    def check(self, spark, rows, tolerance):
        d = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as size", "2 as copies", "'x' as id")
        got = sorted(tuple(r)[:6] for r in mixing.mix(d).collect())
        assert got == sorted(tuple(r)[:6] for r in mixing.mix(d.repartition(3)).collect())  # reruns agree
        words = Counter()
        for _, t, s in rows:
            words[s] += len((t or "").split())
        goal, took, src = targets(words), Counter(), {i: s for i, _, s in rows}
        text = {i: t for i, t, _ in rows}
        for i, size, source_size, target, copies, taken in got:
            assert size == len((text[i] or "").split()) and source_size == words[src[i]]
            assert target == pytest.approx(goal[src[i]]) and taken == size * copies <= 3 * size
            took[src[i]] += taken
        for s in words:
            assert abs(took[s] - goal[s]) <= tolerance, s
        return got

    def test_targets_and_sums(self, spark):
        rng = random.Random(4)
        rows = [(i, "w " * rng.randrange(1, 60), f"s{rng.choice('aaaaaabcdefg')}") for i in range(900)]
        self.check(spark, rows, 30)

    def test_null_source_empty_texts_one_source(self, spark):
        self.check(spark, [(1, "a b c", None), (2, None, "x"), (3, "", "x"), (4, "d e", "x"), (5, "f " * 10, None)], 6)
        assert [r[4] for r in self.check(spark, [(1, "a b", "x"), (2, "c", "x")], 0)] == [1, 1]

    def test_empty_table(self, spark):
        assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0

    def test_inclusion_follows_size_over_many_draws(self, spark):
        sizes = {i: (400, 60, 60, 20)[i % 4] for i in range(24)}
        taken, runs = Counter(), 6
        for seed in range(runs):  # other ids are other draws
            rows = [(1000 * seed + i, "w " * n, "a") for i, n in sizes.items()] + [(1000 * seed + 500 + i, "w " * 300, "b") for i in range(6)]
            for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect():
                if r["doc_id"] % 1000 < 500:
                    taken[sizes[r["doc_id"] % 1000]] += r["copies"]
        words, rest = sum(sizes.values()), (sum(sizes.values()) + 1800) / 3
        assert rest < words
        square = sum(n * n for n in sizes.values())
        for n, count in ((400, 6), (60, 12), (20, 6)):
            want = runs * count * min(1, rest * n / square)
            assert abs(taken[n] - want) <= 4 * (want + 4) ** 0.5, (n, taken[n], want)

    def test_very_large_documents_are_certain(self, spark):
        rows = [(i, "w " * (20 if i else 900), "b") for i in range(40)] + [(100 + i, "w " * 50, "a") for i in range(10)]
        got = {r["doc_id"]: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
        assert got[0]["copies"] == 1 and sum(r["taken"] for i, r in got.items() if i < 100) == pytest.approx(got[0]["target"], abs=20)

    def test_repeated_and_null_ids(self, spark):
        rows = [(None, "a b c", "x"), (None, "a b c", "x"), (5, "d e", "x"), (5, "f g", "y"), (5, "d e", "x")]
        got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
        assert len(got) == 5 and len({(r["doc_id"], r["source"], r["size"], r["copies"]) for r in got}) == 3

    def test_larger_documents_are_likelier(self, spark):
        rows = [(i, "w " * (5 if i % 2 else 50), "a") for i in range(800)] + [(1000 + i, "w " * 50, "b") for i in range(400)]
        got = {r[0]: r[4] for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
        small, large = sum(got[i] for i in range(800) if i % 2), sum(got[i] for i in range(800) if i % 2 == 0)
        assert large > 1.5 * small


class TestEmbeddings:
    def brute(self, rows):
        good = [(i, np.array(v, float), y) for i, v, y in rows if v is not None and y is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
        n, up = Counter(), {i: i for i, *_ in rows}

        def top(x):
            while up[x] != x:
                x = up[x]
            return x

        for k, (i, v, y) in enumerate(good):
            for j, u, z in good[:k]:
                if y == z and len(u) == len(v) and float(v @ u) / np.sqrt(float(v @ v) * float(u @ u)) >= 0.98:
                    n[i] += 1
                    n[j] += 1
                    a, b = top(i), top(j)
                    up[max(a, b)] = min(a, b)
        return {i: (n[i], top(i), top(i) == i) for i, *_ in rows}

    def test_against_all_pairs(self, spark):
        rng = np.random.default_rng(6)
        rows = []
        for g in range(12):
            base = rng.standard_normal(32)
            for k in range(25):
                near = base / np.linalg.norm(base) + rng.standard_normal(32) * rng.choice((0.01, 0.02, 0.03))
                rows.append((len(rows), [float(np.float32(x)) for x in near * rng.choice((1.0, 5.0))], int(g % 3)))
        rows += [(1000 + i, rows[0][1], 0) for i in range(80)]
        rows += [(2000, None, 0), (2001, [0.0] * 32, 0), (2002, [float("nan")] + [1.0] * 31, 0), (2003, [None] + [1.0] * 31, 0), (2004, rows[0][1], None), (2005, [1.0, 2.0], 0), (2006, [2.0, 4.0], 0), (2007, [float("inf")] * 32, 1), (2008, [], 1)]
        d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as id", "'v' as v")
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.near_duplicates(d).collect()}
        want = self.brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], y) for i, v, y in rows])
        links, found = sum(x[0] for x in want.values()), sum(x[0] for x in got.values())
        assert set(got) == set(want) and found <= links and found >= 0.99 * links
        assert sum(got[i] != want[i] for i in want) <= 0.01 * len(want)
        assert all(got[i] == want[i] for i in want if i >= 2000)

    def test_empty_table(self, spark):
        assert embed_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


    @pytest.mark.parametrize("dim, n", [(64, 10**4), (64, 5 * 10**5), (64, 10**7), (3, 100), (1, 5)])
    def test_pairs_at_the_limit_share_a_cap(self, dim, n):
        """Two vectors at a cosine of exactly 0.98, whatever the number of vectors that the code is made for."""
        rng = np.random.default_rng(1)
        unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        x = unit(rng.standard_normal((150, dim)))
        z = rng.standard_normal((150, dim))
        z = unit(z - (z * x).sum(1, keepdims=True) * x)
        code = embed_dedup.ProductCode(dim, n)
        a, b = code.decode(x), code.decode(unit(0.98 * x + np.sqrt(1 - 0.98**2) * z))
        assert np.mean([len(np.intersect1d(p, q)) > 0 for p, q in zip(a, b)]) >= 0.97
        assert np.mean([len(p) for p in a]) < 120

    def test_repeated_and_null_ids(self, spark):
        rows = [(None, [1.0, 2.0], 0), (None, [1.0, 2.0], 0), (3, [1.0, 2.0], 0), (3, [1.0, 2.0], 0), (4, [1.0, 2.001], 0), (5, [-1.0, 2.0], 0), (6, [1.0, 2.0], 1)]
        got = sorted((r["vec_id"] or -1, r["n_links"], r["component_id"]) for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect())
        assert [g[0] for g in got] == [-1, -1, 3, 3, 4, 5, 6] and got[2] == (3, 2, 3) and got[4] == (4, 2, 3) and got[5][1:] == (0, 5) and got[6][1:] == (0, 6)

    def test_ids_that_repeat_with_other_vectors(self, spark):
        rows = [(6, [1.0, 0.0, 0.0], 0), (6, [0.0, 1.0, 0.0], 0), (7, [1.0, 0.01, 0.0], 0), (8, [0.0, 1.0, 0.01], 0), (6, [0.0, 1.0, 0.0], 0), (2, [0.0, 1.0, 0.02], 0), (9, [0.0, 0.0, 1.0], 0)]
        got = embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
        assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == [(2, 3, 2, True), (6, 1, 6, True), (6, 3, 2, False), (6, 3, 2, False), (7, 1, 6, False), (8, 3, 2, False), (9, 0, 9, True)]


class TestParagraphs:
    def test_repeats_inside_and_near(self, spark):
        rng = random.Random(8)
        line = lambda n: " ".join(f"w{rng.randrange(5000)}" + ("." if k % 8 == 7 else "") for k in range(n))
        passage, inner, notice = line(60), line(64), "Licensed under the terms of this short notice."
        near = passage.split()
        near[30] = "changed"
        rows = [(i, "\n".join([line(40), notice, passage if i % 2 else " ".join(near).upper(), line(35)])) for i in range(20)]
        rows += [(50 + i, f"{line(40)} {line(3)} {inner} {line(30)}") for i in range(10)]
        rows += [(100, f"{line(32)}\n{line(32)}"), (101, None), (102, ""), (103, "too short\nto count"), (104, f"{notice}\n{line(50)}"), (105, "\n".join([line(45)] * 2))]
        rows += [(200 + i, passage) for i in range(60)]
        d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as pid", "'x' as words")
        text, got = dict(rows), {}
        for r in para_dedup.dedup_paragraphs(d).collect():
            got.setdefault(r["doc_id"], []).append(r)
        assert set(got) == {*range(20), *range(50, 60), 104, *range(200, 260)}  # 104 by a short paragraph
        for i in [*range(20), *range(200, 260)]:
            (r,) = [r for r in got[i] if r["n_words"] >= 50]
            assert (r["first_doc_id"], r["removed"]) == (0, i != 0)
            assert text[i][r["first_char"] : r["last_char"]].lower().split()[-50:-35] == passage.lower().split()[-50:-35]
        for i in range(50, 60):
            (r,) = got[i]
            assert (r["first_doc_id"], r["removed"]) == (50, i != 50)
            cut = text[i][r["first_char"] : r["last_char"]]
            assert cut.strip(". ") in inner and r["n_words"] >= 48
        assert para_dedup.remove_passages(text[201], [(r["first_char"], r["last_char"]) for r in got[201]]) == ""

    def test_nested_parts_are_found_by_whole_columns(self):
        """op6: each part was a Python dictionary. Random parts, some of them twice, against a plain loop."""
        rng = random.Random(6)
        docs = []
        for i in range(60):
            parts = [(a := rng.randrange(40), a + rng.randrange(1, 12), rng.random() < 0.6, a, 3, rng.randrange(9), rng.randrange(-4, 4)) for _ in range(rng.randrange(30))]
            docs.append((i * 7, parts + parts[:3]))
        names = ("first_char", "last_char", "unit", "first_word", "words", "first_doc", "part")
        kinds = pa.struct([(n, pa.bool_() if n == "unit" else pa.int64() if n in ("first_doc", "part") else pa.int32()) for n in names])
        lists = pa.array([[dict(zip(names, p)) for p in parts] for _, parts in docs], pa.list_(kinds))
        whole = pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs]), lists], ["id", "parts"])
        for batch, given in ((whole, docs), (whole.slice(11, 30), docs[11:41]), (whole.slice(0, 0), [])):
            wanted = []
            for i, parts in given:
                reach = -1
                for p in sorted(set(parts), key=lambda p: (p[0], -p[1], *p[2:])):
                    wanted.append((i, p[1] <= reach, *p))
                    reach = reach if p[2] else max(reach, p[1])
            assert list(zip(*(c.tolist() for c in para_dedup.mark_nested(batch)))) == wanted
            assert para_dedup.tuples(batch.column(1)) == [parts for _, parts in given]

    def units(self, text):
        p = para_dedup.cut_texts([text]).units
        return [text[a:b] for a, b in zip(p["first_char"], p["last_char"])]

    def test_sentences_without_ends(self):
        rng = random.Random(9)
        passage = " ".join(f"w{rng.randrange(5000)}" for _ in range(70))
        cut = lambda before: set(self.units(f"{before} {passage} tail tail tail"))
        assert sum(len(x.split()) for x in cut("a b c d e f g") & cut("some other words stand here before it")) >= 40

    def test_parts_of_a_text(self):
        texts = ["É my dear old friend of mine. Is this it, now?\nNext line: one two three four five.\n\n\tblock two has only a few", None, "", "x y z " * 40 + "end"]
        p = para_dedup.cut_texts(texts)
        said = lambda q: [(int(t), texts[t][a:b], int(w)) for t, a, b, w in zip(q["text"], q["first_char"], q["last_char"], q["first_word"])]
        one, two, three = texts[0].split("\n")[0], texts[0].split("\n")[1], texts[0].split("\t")[1]
        assert said(p.paragraphs) == [(0, one, 0), (0, two, 11), (0, three, 18), (3, texts[3], 0), (0, f"{one}\n{two}", 0)]
        assert said(p.units)[:4] == [(0, one[:29], 0), (0, f"{one[30:]}\n{two}", 7), (0, three, 18), (3, texts[3], 0)] or said(p.units)[0] == (0, one[:29], 0)
        for i in range(len(p.paragraphs["n"])):
            text = texts[p.paragraphs["text"][i]][p.paragraphs["first_char"][i] : p.paragraphs["last_char"][i]].lower().split()
            assert p.paragraphs["n"][i] == len(p.members(i)) == len({tuple(text[k : k + 5]) for k in range(len(text) - 4)})
        again = para_dedup.cut_texts([texts[0].upper().replace("É", "é").replace("é", "É")])
        assert list(again.paragraphs["k1"]) == [k for k, t in zip(p.paragraphs["k1"], p.paragraphs["text"]) if t == 0]

    def test_large_ids(self, spark):
        rng = random.Random(13)
        text = self.line(rng, 60)
        rows = [(10**13, text), (-(10**15), "\n" * 1_100_000 + text), (None, text)]
        got = para_dedup.dedup_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted((r["doc_id"], r["first_doc_id"], r["removed"]) for r in got) == [(-(10**15), -(10**15), False), (10**13, -(10**15), True)]

    def test_against_all_pairs_of_paragraphs(self, spark):
        """Verdicts of whole paragraphs against comparing all pairs by exact Jaccard, one line a document."""
        rng = random.Random(14)
        texts = []
        for _ in range(12):
            base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice((6, 9, 20, 60)))]
            for _ in range(8):
                w = list(base)
                for _ in range(rng.choice((0, 0, 1, 2))):
                    w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
                texts.append(" ".join(w))
        rng.shuffle(texts)
        sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
        up = list(range(len(texts)))

        def top(x):
            while up[x] != x:
                x = up[x]
            return x

        for a in range(len(texts)):
            for b in range(a):
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = top(a), top(b)
                    up[max(x, y)] = min(x, y)
        size = Counter(top(i) for i in range(len(texts)))
        want = {i: (top(i), top(i) != i) for i in range(len(texts)) if size[top(i)] > 1}
        got = {}
        d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        for r in para_dedup.repeated(d).where("not unit").collect():
            got[r["id"]] = (r["first_doc"], r["first_doc"] != r["id"])
        assert got == want

    def line(self, rng, n, every=12):
        return " ".join(f"w{rng.randrange(5000)}" + ("." if k % every == every - 1 else "") for k in range(n))

    def test_short_wrapped_and_edited(self, spark):
        rng = random.Random(10)
        line = lambda n: self.line(rng, n)
        near, notice, wrapped, five = line(28).replace(".", ""), line(7).replace(".", ""), line(60).split(), line(60).split(". ")
        lines = lambda n: "\n".join(" ".join(wrapped[i : i + n]) for i in range(0, 60, n))
        edited = [*five[:2], line(12).rstrip("."), *five[3:]]
        other = near.replace(near.split()[-1], "changed")
        rows = [(1, f"{line(40)}\n{near}"), (2, f"{other}\n{line(40)}"), (3, f"{notice}\n{line(40)}"), (4, f"{line(40)}\n{notice}")]
        rows += [(5, f"{line(36)}\n{lines(11)}\n{line(24)}"), (6, f"{line(24)}\n{lines(14)}\n{line(36)}"), (7, f"{line(36)} {'. '.join(five)} {line(36)}"), (8, f"{line(36)} {'. '.join(edited)} {line(36)}")]
        d, got = spark.createDataFrame(rows, "doc_id long, text string"), {}
        for r in para_dedup.dedup_paragraphs(d, least_words=para_dedup.MIN_WORDS).collect():
            got.setdefault(r["doc_id"], []).append((r["first_doc_id"], r["removed"], r["n_words"]))
        assert {i: sorted(x) for i, x in got.items()} == {
            **{1: [(1, False, 28)], 2: [(1, True, 28)], 3: [(3, False, 7)], 4: [(3, True, 7)], 5: [(5, False, 60)], 6: [(5, True, 60)]},
            **{7: [(7, False, 24)] * 2, 8: [(7, True, 24)] * 2},
        }

    def test_cuts_depend_on_words_near_by(self):
        rng = random.Random(11)
        words = [str(rng.randrange(5000)) for _ in range(400)]
        ends = lambda ws: set(para_dedup.cut_texts([" ".join(ws)]).units["end"].tolist())
        whole = ends(words)
        for start in range(1, 60):
            assert {c + start for c in ends(words[start:])} - whole <= set(range(start, start + 10)) and {c for c in whole if c > start + 10} <= {c + start for c in ends(words[start:])}

    def test_what_is_removed_stays_in_its_first_document(self, spark):
        rng = random.Random(12)
        line = lambda n: self.line(rng, n)
        p, p1, p2, stock = line(48), line(48), line(48), line(12)
        p = f"{p} {stock}"
        near = p1.split()
        near[30] = "changed"
        edit = " ".join(near).split(". ")[2] + "."  # stands in a near copy, and by itself
        rows = [(2, f"{stock} {line(30)}\n{p1}"), (5, f"{p}\n{line(40)}\n{p1}\n{p2}"), (7, f"{line(20)}\n{' '.join(near)}"), (9, f"{p2}\n{line(40)}\n{p}"), (11, f"{line(36)} {edit} {line(36)}")]
        d, text = spark.createDataFrame(rows, "doc_id long, text string"), dict(rows)
        gone = {}
        for r in para_dedup.dedup_paragraphs(d, least_words=para_dedup.MIN_WORDS).where("removed").collect():
            gone.setdefault(r["doc_id"], []).append((r["first_char"], r["last_char"]))
        left = {i: para_dedup.remove_passages(t, gone.get(i, [])) for i, t in text.items()}
        assert p in left[5] and p not in left[9] and p2 in left[5] and p2 not in left[9] and p1 in left[2] and p1 not in left[5]
        assert edit in left[7] and edit not in left[11] and stock in left[2]

    def test_empty_table(self, spark):
        assert para_dedup.dedup_paragraphs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
