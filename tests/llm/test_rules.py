import random
from collections import Counter

from tests.llm.common import SCHEMA, WORD, odd_rows, odd_table
from worklens.llm import rules


def plain_metrics(text):
    words = WORD.findall(text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""),
        len(lines) - len(set(lines)), len(covered),
    )


def test_metrics(spark):
    random.seed(5)
    rows = odd_rows() + [
        (100 + i, " ".join(random.choices(["a", "b", "ü#", "|", "\n", "c\n"], k=random.randint(0, 40))), "en", "s", 1)
        for i in range(60)
    ]
    found = rules.quality_verdicts(odd_table(spark, rows)).selectExpr(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"
    )
    want = []
    for doc_id, text, *_ in rows:
        m = plain_metrics(text)
        want.append((str(doc_id), *m, m[0] < 50 or 100 * m[4] > 50 * m[0]))
    assert sorted((str(r[0]), *r[1:]) for r in found.collect()) == sorted(want)


def quantile(values, thousandths):
    """The least value of a bin whose running count reaches the share."""

    def bin_of(v):
        shift = max(v.bit_length() - 6, 0)
        return v >> shift << shift

    binned, upto = sorted(Counter(map(bin_of, values)).items()), 0
    for value, n in binned:
        upto += n
        if 1000 * upto >= thousandths * len(values):
            return value


def limits_of(values, metric):
    limit = rules.LIMITS[metric]
    low, mid, high = (quantile(values, q) for q in (1000 - limit.quantile, 500, limit.quantile))
    width = {v: 1 << max(v.bit_length() - 6, 0) for v in (mid, high)}
    lowest = low - limit.reach * max(mid - low, width[mid]) if limit.two_sided else -1
    return lowest, high + limit.reach * max(high - mid, width[high])


MEASURED = (
    "lang string, source string, n_words long, word_chars long, n_symbols long, n_lines long,"
    " n_dup_lines long, n_repeat_words long"
)


def found_limits(spark, measured):
    df = spark.createDataFrame(measured, MEASURED)
    rows = rules.thresholds(rules.sketches(df), rules.AdaptiveRules()).collect()
    return {(r.t_lang, r.t_source): r for r in rows}


def test_thresholds_per_group_with_fallbacks(spark):
    """A large source has its own limits, a small one its language's, a rare language all's."""
    random.seed(6)
    groups = [("en", "big", 150), ("en", "small", 20), ("de", "tiny", 10)]
    measured, lengths = [], {}
    for lang, source, n in groups:
        for _ in range(n):
            length = random.randint(3000, 9000)
            measured.append((lang, source, 100, length // 10, 0, 5, 0, 0))
            lengths.setdefault((lang, source), []).append(1000 * (length // 10) // 100)
    limits = found_limits(spark, measured)
    big, small, tiny = (lengths[g[:2]] for g in groups)
    for key, values in (
        (("en", "big"), big), (("en", "small"), big + small), (("de", "tiny"), big + small + tiny),
    ):
        got = limits[key]
        assert (got.word_length_low, got.word_length_high) == limits_of(values, "word_length")


def test_each_source_has_limits_of_its_own_spread(spark):
    """Production settings: what is usual in one source is an outlier in another."""
    random.seed(8)
    spreads, measured, rates = {"plain": 1, "tables": 9}, [], {}
    for source, spread in spreads.items():
        for _ in range(400):
            words, symbols = 1000, random.randint(0, 20 * spread)
            lines, same = 1000, random.randint(0, 30 * spread)
            again, chars = random.randint(0, 40 * spread), 5000 + random.randint(-100, 100) * spread
            measured.append(("en", source, words, chars, symbols, lines, same, again))
            for metric, v in (("symbols", symbols), ("dup_lines", same), ("repeats", again), ("word_length", chars)):
                rates.setdefault((source, metric), []).append(v)
    measured += [("en", "plain", 10, 10**6, 10**6, 1, 0, 9)] * 300  # they fail the base: not counted
    limits = found_limits(spark, measured)
    for metric in rules.RATES:
        own = {}
        for source in spreads:
            got = limits["en", source]
            own[source] = (got[f"{metric}_low"], got[f"{metric}_high"])
            assert own[source] == limits_of(rates[source, metric], metric)
        assert own["plain"][1] < own["tables"][1] and own["plain"] != own["tables"]


def test_a_group_without_limits(spark):
    rows = [(i, "short", "en", "s", 1) for i in range(3)]
    found = rules.quality_verdicts(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.base_failed, r.kept) for r in found] == [(True, False)] * 3


def test_junk_goes_and_prose_stays(spark):
    random.seed(7)
    words = [f"word{i}" for i in range(500)]
    rows = [(i, " ".join(random.choices(words, k=80)), "en", "s", 1) for i in range(200)]
    rows.append((900, " ".join(w + "###" for w in random.sample(words, 80)), "en", "s", 1))
    rows.append((901, " ".join(w * 9 for w in random.sample(words, 80)), "en", "s", 1))
    rows.append((902, "too short", "en", "s", 1))
    stay = rules.keep_by_quality(spark.createDataFrame(rows, SCHEMA))
    assert sorted(r.doc_id for r in stay.collect()) == list(range(200))
