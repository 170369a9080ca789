import math
import random
import re
from collections import Counter

import pytest

from lakewarden.llm import quality_rules as Q


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    triples = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = set()
    for i in range(len(words) - 2):
        if triples[tuple(words[i:i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    lines, seen, duplicates = 0, set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += 1
            duplicates += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), lines,
            duplicates, len(hit))


def test_measures(odd_texts):
    chosen = random.Random(1)
    texts = [t or "" for t in odd_texts] + [
        "".join(chosen.choice(["a", "b ", "é ", "# ", "\n", "c d e ", "\t"]) for _ in range(60))
        for _ in range(100)]
    for text in texts:
        assert Q.measure(text.encode()) == brute(text)


def test_bound_is_the_exact_binomial_tail():
    for k, n, p in ((0, 10, 0.3), (3, 50, 0.2), (7, 400, 0.05)):
        tail = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert Q._log_tail(k, n, p) == pytest.approx(math.log(tail))
        assert Q.bounded(k, n, p, tail * 1.001) and not Q.bounded(k, n, p, tail * 0.999)
    assert not Q.bounded(0, 0, 0.1, 0.05) and not Q.bounded(5, 10, 0.1, 0.05)
    assert Q.bounded(100_000, 10_000_000, 0.02, 1e-9)


def test_cutoffs_spare_good_documents_and_catch_junk(spark, make_docs, work):
    chosen = random.Random(5)

    def words(n, end=""):
        return " ".join("".join(chosen.choice("abcdefg") for _ in range(5)) + end
                        for _ in range(n))

    rows = [(i, words(80)) for i in range(1500)]
    rows += [(2000 + i, words(80, "***")) for i in range(50)]
    rows += [(3000, None), (3001, "a b c " * 40), (None, words(60)), (5, words(60)), (5, words(60))]
    labels = spark.createDataFrame(
        [(i, 1, "x") for i in range(1500)] + [(2000 + i, 0, "x") for i in range(50)]
        + [(None, 1, "x"), (99_999, 1, "x"), (7, None, "x")],
        "doc_id bigint, quality int, lang string")
    found = Q.judge(make_docs(rows), labels, work).collect()
    assert len(found) == len(rows)
    kept = {r["doc_id"]: r["kept"] for r in found}
    assert not any(kept[2000 + i] for i in range(50))
    assert sum(kept[i] for i in range(1500)) >= 1500 * (1 - len(Q.RULES) * Q.RISK)
    assert not kept[3000] and not kept[3001] and kept[None]


def test_without_labels_only_the_base_rule_works(spark, make_docs, work):
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    rows = [(1, "x*** " * 3 + " ".join(f"w{i}***" for i in range(60))), (2, "few words")]
    assert {r["doc_id"]: r["kept"] for r in Q.judge(make_docs(rows), labels, work).collect()} == {
        1: True, 2: False}
    assert Q.judge(make_docs([]), labels, work + "-none").collect() == []


def holdout(spark, sizes):
    """Labelled measures: per language so many good documents and so many full of symbols."""
    rows = [(lang, good, 100, 450, 0 if good else 300, 10, 0, 0)
            for lang, n_good, n_bad in sizes
            for good, n in ((True, n_good), (False, n_bad)) for _ in range(n)]
    return spark.createDataFrame(rows, "lang string, good boolean, "
                                 + ", ".join(f"{m} bigint" for m in (
                                     "n_words", "word_chars", "n_symbols", "n_lines",
                                     "n_dup_lines", "n_repeat_words")))


def lost(spark, labelled):
    """Documents turned down, by language and label."""
    found = Q.with_verdict(labelled, "lang", *Q.cutoffs(labelled, "lang"))
    return Counter((r["lang"], r["good"]) for r in found.where("NOT passed").collect())


def test_the_least_stratum_passes_the_bound():
    for tests in (1, 5, 20, 325):
        n = Q.least_size(tests, Q.RISK, Q.ALPHA)
        assert Q.bounded(0, n, Q.RISK, Q.ALPHA / tests)
        assert n == 1 or not Q.bounded(0, n - 1, Q.RISK, Q.ALPHA / tests)


@pytest.mark.parametrize("good", [200, 307, 450, 600])
def test_strata_of_any_size_lose_their_junk(spark, good):
    sizes = [("en", 2000, 100), ("de", 480, 80), ("fr", 470, 80), ("es", good, 32), (None, 90, 9)]
    turned_down = lost(spark, holdout(spark, sizes))
    assert turned_down == {(lang, False): bad for lang, _, bad in sizes}


def test_cutoffs_of_all_strata_are_not_for_unlabelled_ones(spark):
    labelled = holdout(spark, [("en", 2000, 100), ("es", 40, 5)])
    chosen = Q.cutoffs(labelled, "lang")
    others = holdout(spark, [("xx", 0, 3), ("es", 0, 3)])
    kept = Q.with_verdict(others, "lang", *chosen).where("passed").collect()
    assert [r["lang"] for r in kept] == ["xx"] * 3


def many_strata(spark):
    """70 values with 450 good documents each; value i has good ones with i/20 symbols a word."""
    rows = spark.range(70 * 500).selectExpr("CAST(id % 70 AS STRING) AS lang", "id DIV 70 < 450 AS good")
    return rows.selectExpr(
        "lang", "good", "100L AS n_words", "450L AS word_chars",
        "CASE WHEN good THEN CAST(lang AS BIGINT) * 5 ELSE CAST(lang AS BIGINT) * 5 + 12 END AS n_symbols",
        "10L AS n_lines", "0L AS n_dup_lines", "0L AS n_repeat_words")


def test_every_stratum_keeps_its_own_cutoffs(spark):
    labelled = many_strata(spark)
    table, pooled = Q.cutoffs(labelled, "lang")
    assert table.count() == 70 and pooled == {}
    turned_down = lost(spark, labelled)
    # The grid ends at 2 symbols a word; up to there each value loses its own junk and nothing good.
    assert turned_down == {(str(i), False): 50 for i in range(41)}


def plain_kept(rows):
    """The verdict of (lang, good, measures) rows, as the docstring has it, in plain Python."""
    def rate(row, rule):
        m = dict(zip(Q.MEASURES, row[2], strict=True))
        return m[rule.part] / m[rule.whole] if m[rule.whole] else None

    def over(row, rule, cut):
        return rate(row, rule) is not None and (rate(row, rule) - cut) * rule.sign > 0

    def tail(k, n):
        return sum(math.comb(n, i) * Q.RISK**i * (1 - Q.RISK) ** (n - i) for i in range(k + 1))

    judged = [r for r in rows if r[2][0] >= 50 and 100 * r[2][5] <= 50 * r[2][0]]
    goods = Counter(r[0] for r in judged if r[1])
    for least in sorted(set(goods.values())):
        own = {v for v, n in goods.items() if n >= least}
        tests = (len(own) + any(n < least for n in goods.values())) * len(Q.RULES)
        if tail(0, least) <= Q.ALPHA / tests:
            break
    else:
        own, tests = set(), len(Q.RULES)
    pool = [r for r in judged if r[0] not in own]
    too_few = 0 < sum(r[1] for r in pool) and tail(0, sum(r[1] for r in pool)) > Q.ALPHA / tests
    known = {}

    def cut_of(value, rule):
        name = value if value in own else "rest" if goods[value] or not too_few else "unknown"
        if (name, rule.name) not in known:
            group = ([r for r in judged if r[0] == value] if value in own
                     else [] if name == "unknown" else judged if too_few else pool)
            n, cut = sum(r[1] for r in group), None
            for c in rule.grid:
                hit = [r[1] for r in group if over(r, rule, c)]
                if not n or sum(hit) >= Q.RISK * n or tail(sum(hit), n) > Q.ALPHA / tests:
                    break
                if len(hit) > sum(hit) and len(hit) - sum(hit) >= sum(hit):
                    cut = c
            known[name, rule.name] = cut
        return known[name, rule.name]

    base = {id(r) for r in judged}
    return [id(row) in base and not any(
        cut_of(row[0], rule) is not None and over(row, rule, cut_of(row[0], rule)) for rule in Q.RULES)
        for row in rows]


@pytest.mark.parametrize("seed", [1, 2])
def test_kept_equals_a_plain_version(spark, make_docs, work, seed):
    chosen = random.Random(seed)

    def text(bad):
        words = ["".join(chosen.choices("abcdefghij", k=chosen.randrange(2, 9)))
                 for _ in range(chosen.randrange(45, 70))]
        kind = chosen.randrange(4) if bad else 9
        words = [w + ("#$" if kind == 0 else "") for w in words]
        words = words[:12] * 2 + words if kind == 1 else words
        return "\n".join(["a line", *(["a line"] * 60 if kind == 2 else []), " ".join(words)])

    langs = ["en"] * 8 + ["de"] * 6 + ["x", None] if seed == 1 else ["en"] * 12 + ["y"] * 3 + ["z"]
    docs, given = [], []
    for i in range(900):
        bad = chosen.random() < 0.15
        docs.append((i, text(bad), chosen.choice(langs), not bad if chosen.random() < 0.97 else bad))
    labels = spark.createDataFrame([(i, int(good)) for i, _, lang, good in docs],
                                   "doc_id bigint, quality int")
    given = [(lang, good, Q.measure(t.encode())) for _, t, lang, good in docs]
    df = make_docs([(i, t) for i, t, _, _ in docs]).drop("lang").join(
        spark.createDataFrame([(i, lang) for i, _, lang, _ in docs], "doc_id bigint, lang string"), "doc_id")
    found = {r["doc_id"]: r["kept"] for r in Q.judge(df, labels, work).collect()}
    assert [found[i] for i in range(900)] == plain_kept(given)
    assert not all(found.values()) and any(found.values())
