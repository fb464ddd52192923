
import pytest
from pyspark.sql import functions as F

from trovelake import fixed_values as fv
from trovelake.operators import answering as an
from trovelake.operators import generators as gen

CONTEXTS = "array<struct<text:string,citation:string,score:double>>"
HISTORY = "array<struct<user:string,assistant:string>>"


def value(spark, column, contexts, question="cat dog", history=None, answer=None):
    rows = [(question, contexts, history, answer)]
    df = spark.createDataFrame(rows, f"question string, contexts {CONTEXTS}, history {HISTORY}, answer string")
    return df.select(column).first()[0]


def extracted(spark, contexts, question="cat dog"):
    return value(spark, an.extractive_answer(F.col("question"), F.col("contexts")), contexts, question)


def test_two_closest_sentences_per_context(spark):
    contexts = [
        ("No. A dog! One cat dog? Cat.", "S1 / h", 1.0),
        ("A dog! Other.", "S1 / h", 0.9),
        ("Third one. Fourth.", "S2 / h", 0.8),
        ("Never reached.", "S3 / h", 0.7),
    ]
    answer = extracted(spark, contexts)
    assert answer == "One cat dog? A dog! Other. Third one.\n\nИсточники: [S1 / h] [S2 / h]"


def test_a_context_without_new_sentences_is_still_cited(spark):
    contexts = [("Cat.", f"S{i} / h", 1.0) for i in range(5)]
    assert extracted(spark, contexts) == "Cat.\n\nИсточники: [S0 / h] [S1 / h] [S2 / h]"


def test_empty_and_missing_contexts(spark):
    assert extracted(spark, []) == fv.NO_CONTEXT_ANSWER
    assert extracted(spark, None) == fv.NO_CONTEXT_ANSWER
    assert extracted(spark, [(" ", "S / h", 1.0)]) == f"{fv.UNCERTAIN_ANSWER}\n\nИсточники: [S / h]"


def test_citation_check_and_repair(spark):
    contexts = [("t", f"S{i} / h", 1.0) for i in range(4)]

    def check(answer):
        fixed = an.repair_citations(F.col("answer"), F.col("contexts"))
        valid = an.citations_valid(F.col("answer"), F.col("contexts"))
        return value(spark, F.struct(valid, fixed), contexts, answer=answer)

    assert tuple(check("plain")) == (True, "plain")
    assert tuple(check("ok [S3 / h]")) == (True, "ok [S3 / h]")
    assert tuple(check("bad [X] [S1 / h]")) == (
        False,
        "bad [X] [S1 / h]\n\nПроверенные источники: [S0 / h] [S1 / h] [S2 / h]",
    )


def test_gate_reads_the_first_context(spark):
    gate = an.is_relevant(F.col("contexts"))
    assert value(spark, gate, [("t", "c", 0.12), ("t", "c", 0.0)]) is True
    assert value(spark, gate, [("t", "c", 0.11), ("t", "c", 0.9)]) is False
    assert value(spark, gate, []) is False
    assert value(spark, gate, None) is False


def test_chat_messages(spark):
    column = an.chat_messages(F.col("question"), F.col("contexts"), F.col("history"))
    contexts = [("one", "S1 / h", 1.0), ("two", "S2 / h", 1.0)]
    messages = value(spark, column, contexts, "Q", [("u", "a")])
    assert [m.role for m in messages] == ["system", "user", "assistant", "user"]
    assert messages[0].content == fv.SYSTEM_PROMPT
    assert messages[3].content == "Контекст:\n[S1 / h]\none\n\n[S2 / h]\ntwo\n\nВопрос клиента: Q"
    assert len(value(spark, column, contexts, "Q", None)) == 2


def generate(spark, generator):
    column = generator.generate(F.col("question"), F.col("contexts"), F.col("history"))
    return value(spark, column, [("one", "S1 / h", 1.0)], "Q", [("u", "a")])


def test_chat_completion_back_end(spark):
    from types import SimpleNamespace

    def client():
        def create(model, messages, temperature, max_tokens):
            text = f"{model} {len(messages)} {temperature} {max_tokens}" if messages[-1]["content"] else None
            message = SimpleNamespace(content=text)
            return SimpleNamespace(choices=[SimpleNamespace(message=message)])

        return SimpleNamespace(chat=SimpleNamespace(completions=SimpleNamespace(create=create)))

    assert generate(spark, gen.OpenAIGenerator("m", client_factory=client)) == "m 4 0.2 500"


def test_http_chat_back_end(spark):
    def post(url, data, timeout):
        import json

        body = json.loads(data)

        class Reply:
            def raise_for_status(self):
                pass

            def json(self):
                text = f"{url} {body['model']} {body['stream']} {body['options']['num_predict']} {timeout}"
                return {"message": {"content": text}}

        return Reply()

    config = gen.GenerationConfig(max_tokens=9)
    generator = gen.OllamaGenerator("m", "http://host/api", config, post)
    assert generate(spark, generator) == "http://host/api m False 9 60"


def test_factory(monkeypatch):
    assert isinstance(gen.create_generator(), gen.RuleBasedGenerator)
    assert isinstance(gen.create_generator("openai"), gen.OpenAIGenerator)
    monkeypatch.setenv(gen.BACKEND_VARIABLE, "ollama")
    assert isinstance(gen.create_generator(), gen.OllamaGenerator)
    with pytest.raises(ValueError):
        gen.create_generator("oracle")
