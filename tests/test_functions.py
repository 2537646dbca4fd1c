import math

import pytest
from pyspark.sql import functions as F

from docengine.functions import metrics as M
from docengine.functions import money, text as X


def value(spark, column, **row):
    names = list(row)
    schema = ", ".join(f"{k} {'array<array<string>>' if isinstance(v, list) and v and isinstance(v[0], list) else 'array<string>' if isinstance(v, list) else 'double' if isinstance(v, float) else 'long' if isinstance(v, int) else 'string'}" for k, v in row.items())
    return spark.createDataFrame([tuple(row[n] for n in names)], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize("make,given,want", [
    (lambda c: X.clean_text(c), "제1장 사업개요 .......... 3", "제1장 사업개요 3"), (lambda c: X.clean_text(c), None, ""), (lambda c: X.clean_text(c), "Ａ\x00b\t\t c \n\n\n\n d氠瑢e – “x”", 'Ab c\n\nd e - "x"'),
    (lambda c: X.normalize_for_eval(c), "130,000,000원", "130000000원"), (lambda c: X.normalize_for_eval(c), "063-716-2787", "0637162787"), (lambda c: X.normalize_for_eval(c), "제한 경쟁 입찰", "제한경쟁입찰"),
    (lambda c: X.normalize_for_eval(c), "개인정보·처리", "개인정보처리"), (lambda c: X.normalize_for_eval(c), None, ""), (lambda c: X.normalize_file_name(c), " 가나 ㈜ Ａ（1）–x.PDF ", "가나(주)ａ(1)-x.pdf"),
    (lambda c: X.normalize_for_chunking(c, zero_width=True), "a\r\n​ b　c \n\n\n\nd", "a\nb c\n\nd"), (lambda c: X.normalize_page(c), " NaN ", ""), (lambda c: X.minimal_clean(c), "a★ b  c \n\n\n\n d", "a b c\n\nd"),
    (lambda c: X.single_line_clean(c), " a\nb é★ 12% (x) ", "a b 12% (x)"), (lambda c: X.prepare_for_toc(c), "가★나\tⅣ ①", "가 나 Ⅳ ①"),
    (lambda c: X.guarded_clean(c), "- 3 -\n본문 제 3  조 과업지시서\n[Page 2]\n① 　x 1 .", "본문 제3조 \n① x 1."), (lambda c: X.guarded_clean(c), "<table><tr><td>a</td><td>b</td></tr><tr><td>1</td><td>2</td></tr></table>", "| a | b |\n|---| ---|\n| 1 | 2 |"),
    (lambda c: X.strip_reasoning(c), "<think>x\ny</think>Okay, let me see\nmore\n- 답", "- 답"), (lambda c: X.strip_reasoning(c), "답", "답"), (lambda c: X.clean_title(c, drop_page=True), "1. 개요 ...... 12", "1. 개요"),
    (lambda c: X.safe_name(c), " a/b c ", "a_b_c"), (lambda c: X.cell_to_markdown(c), "a|b\nc", "a\\|b<br>c"),
])
def test_text(spark, make, given, want):
    got = value(spark, make(F.col("c")), c=given)
    if "---|" in (want or ""):
        got, want = got.replace(" ", ""), want.replace(" ", "")
    assert got == want


def test_rows_to_markdown(spark):
    rows = spark.createDataFrame([([["a", "b"], ["", None], ["1"]],), ([],)], "r array<array<string>>")
    assert [r.x for r in rows.select(X.rows_to_markdown(F.col("r")).alias("x")).collect()] == ["| a | b |\n| --- | --- |\n| 1 |  |", ""]


def test_flags(spark):
    assert value(spark, X.is_broken_table(F.col("c")), c="| a | b |\n| --- | --- |\n| c | d | e |") and not value(spark, X.is_broken_table(F.col("c")), c="| a |\n| b |\nx")
    assert value(spark, X.is_table_text(F.col("c")), c="| --- |") and [value(spark, X.is_null_like(F.col("c")), c=x) for x in (None, " N/A ", "nan", "x")] == [True, True, True, False]
    path = value(spark, X.section_id(F.lit("d"), F.col("c"), F.lit(3)), c=["a b", "나!", "c", "e"])
    assert path == "d_sec_0003_나_c_e"


@pytest.mark.parametrize("amount,want", [(130000000, "1억3천만원"), (150000000, "1억5천만원"), (11270000000, "112억7천만원"), (0, "0원"), (300000000, "3억"), (12340000, "1천2백3십4만원")])
def test_short_won(spark, amount, want):
    assert value(spark, money.short_won(F.col("c")), c=amount) == want
    assert value(spark, money.won_with_commas(F.col("c")), c=amount) == f"{amount:,}원"


def test_amounts(spark):
    assert [money.korean_number(x) for x in ("삼천오백만", "일억 이천", "십", "만", "x", "", None)] == [35_000_000, 100_002_000, 10, 10_000, None, None, None]
    assert money.spell_amounts("약 1,200만원 및 삼천만원, 5억원") == "약 12000000원 및 30000000원, 500000000원"
    assert money.spell_amounts("사원", hangul=False) == "사원" and money.spell_amounts(None) == ""
    assert value(spark, money.amount_of_keywords(F.col("c")), c=[["예산"], ["1,300원"]]) == 1300 and value(spark, money.amount_of_text(F.col("c")), c="없음") is None


def ids(x):
    return F.array(*map(F.lit, x))


def test_retrieval_metrics(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    run, gold = ids(["d1", "d3", "d4"]), ids(["d1", "d2"])
    assert get(M.precision_at(run, gold, 3)) == pytest.approx(1 / 3) and get(M.recall_at(run, gold, 3)) == 0.5 and get(M.top1(run, gold)) == 1
    assert get(M.reciprocal_rank(ids("AAB"), ids("B"), 5)) == pytest.approx(1 / 3) and get(M.reciprocal_rank(F.array_distinct(ids("AAB")), ids("B"), 5)) == 0.5
    assert get(M.ndcg_at(ids(["d1", "d2"]), ids(["d1"]), 5)) == 1.0 and get(M.ndcg_at(ids(["x", "d1"]), ids(["d1"]), 5)) == pytest.approx(1 / math.log2(3))
    assert get(M.average_precision_at(ids("xAB"), ids("AB"), 5)) == pytest.approx((1 / 2 + 2 / 3) / 2) and get(M.first_rank(ids("xy"), ids("A"), 5)) is None
    assert [get(M.hit_at(ids(r), ids(g), 3)) for r, g in (("317", "1"), ("ab2", "2"), ("xyz", "q"))] == [1, 1, 0]


@pytest.mark.parametrize("gold,answer,want", [("a b b", "b b c", 2 / 3), ("", "", 1.0), ("a", "", 0.0), (None, "", 1.0), ("a", "b", 0.0)])
def test_token_f1(spark, gold, answer, want):
    assert value(spark, M.token_f1(F.col("g"), F.col("a")), g=gold, a=answer) == pytest.approx(want)


def test_bleu_and_rouge():
    assert M.bleu_score("a b c d", "a b c d") == pytest.approx(1) and M.bleu_score("a b", "c d") == 0 and M.bleu_score("", "x") == 0
    assert M.bleu_score("the cat is on the mat", "the cat sat on the mat") > M.bleu_score("the cat is on the mat", "on mat there is a cat") > 0
    assert M.bleu_score("a b c d e f", "a b c") == pytest.approx(math.exp(0.25 * math.log(0.1)) * math.exp(-1))

    def lcs(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]

    import random

    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(1, 12))] for _ in range(2))
        assert M.rouge_l_score(" ".join(a), " ".join(b)) == pytest.approx(2 * lcs(a, b) / (len(a) + len(b)))
    assert M.rouge_l_score("가 나", "가 나") == 0 and M.rouge_l_score("가 나", "가 나", any_script=True) == 1


def test_cost_and_rank(spark):
    assert value(spark, M.llm_cost(F.lit(1_000_000), F.lit(1_000_000), F.lit(0.15), F.lit(0.6)) + F.col("c"), c=0.0) == pytest.approx(0.75)
    assert value(spark, M.nearest_rank(F.array(*map(F.lit, (1.0, 2.0, 3.0, 4.0))), 0.5) + F.col("c"), c=0.0) == 3.0
