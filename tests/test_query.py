import random

from pyspark.sql import functions as F

from trovelake import fixed_values as fv
from trovelake.functions.text import tokenize
from trovelake.operators import query


def row_of(spark, text, column, product=None):
    df = spark.createDataFrame([(text, product)], "q string, p string")
    return df.select(column).first()[0]


def inferred(spark, text):
    return row_of(spark, text, query.infer_product(tokenize(F.col("q"))))


def test_infer_product(spark):
    assert inferred(spark, "Как погасить кредит?") == "loan"
    assert inferred(spark, "Где статус моей заявки") == "faq"
    assert inferred(spark, "вклад вклад вклад и доход, отказ") == "borrower"  # distinct words count
    assert inferred(spark, "кредит или вклад") == "loan"  # first declared wins a tie
    assert inferred(spark, "погода") is None
    assert row_of(spark, "кредит", query.infer_product(tokenize(F.col("q")), {})) is None


def test_effective_product(spark):
    def chosen(text, product):
        return row_of(spark, text, query.effective_product(F.col("p"), tokenize(F.col("q"))), product)

    assert chosen("кредит", "faq") == "faq"
    assert chosen("кредит", None) == "loan"
    assert chosen("кредит", "") is None  # empty: neither filter nor inference


def test_expansion(spark):
    def texts(text, **kw):
        df = spark.createDataFrame([(1, text)], "qid int, query string")
        return [r.text for r in query.explode_variants(df, **kw).orderBy("variant").collect()]

    suffix = [s for _, s in fv.EXPANSION_RULES]
    assert texts("Паспорт и проценты") == [
        "Паспорт и проценты",
        f"Паспорт и проценты {suffix[0]}",
        f"Паспорт и проценты {suffix[1]}",
    ]
    assert texts("стаж") == ["стаж", f"стаж {suffix[3]}"]
    assert texts("погода") == ["погода"]
    assert texts("ставка", multi=False) == ["ставка"]
    assert texts("b", rules=[(["a"], "x"), (["b"], "y")]) == ["b", "b y"]


HISTORY = "array<struct<user:string,assistant:string>>"


def test_history_prefix(spark):
    def text(history):
        df = spark.createDataFrame([("Q", history)], f"q string, h {HISTORY}")
        return df.select(query.with_history(F.col("q"), F.col("h"))).first()[0]

    turns = [("u1", "a1"), ("u2", "a2"), ("u3", "a3")]
    assert text(None) == "Q"
    assert text([]) == "Q"
    assert text(turns[:1]) == "Клиент: u1 Консультант: a1 Новый вопрос: Q"
    assert text(turns) == "Клиент: u2 Консультант: a2 Клиент: u3 Консультант: a3 Новый вопрос: Q"


def test_conversation_history_of_one_very_long_conversation(spark):
    """One conversation holds most rows and spans many segments."""
    random.seed(3)
    turns = [(1, t, random.choice(["user", "assistant", "user", "assistant", "system"])) for t in range(400)]
    turns += [(2, 0, "user"), (2, 1, "assistant"), (2, 2, "user"), (3, 0, "user")]
    rows = [(c, t, r, f"{c}.{t}") for c, t, r in turns]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    role = {(c, t): r for c, t, r in turns}

    def past(c, t):
        out = []
        for back in (2, 4):
            if role.get((c, t - back)) != "user" or role.get((c, t - back + 1)) != "assistant":
                break
            out.insert(0, (f"{c}.{t - back}", f"{c}.{t - back + 1}"))
        return out

    for segment in (8, 64):
        got = query.conversation_questions(df, segment).collect()
        assert len(got) == sum(r == "user" for r in role.values())
        for r in got:
            assert [tuple(h) for h in r.history] == past(r.conv_id, r.turn), (r.conv_id, r.turn)
