"""Which documents contain which question texts, in one pass over the documents."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def containing(documents: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, doc_pos, doc_id, product_type) for each text of a counted block that a body contains.

    ``documents``: doc_pos, doc_id, product_type, body; ``questions``: qid, query.  One
    automaton holds the texts of the block, so a task reads each body once whatever their
    number.  Empty and null texts are contained in nothing.
    """
    asked: dict[str, list[int]] = {}
    for row in questions.select("qid", "query").collect():
        if row.query:
            asked.setdefault(row.query, []).append(row.qid)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for text, qids in asked.items():
            automaton.add_word(text, qids)
        automaton.make_automaton()
        for batch in batches:
            pairs = [
                (row, qid)
                for row, body in enumerate(batch.column(3).to_pylist())
                for qid in sorted({q for _, qids in (automaton.iter(body) if asked and body else ()) for q in qids})
            ]
            rows = pa.array([row for row, _ in pairs], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([q for _, q in pairs], pa.int64()), *(batch.column(i).take(rows) for i in range(3))],
                names=["qid", "doc_pos", "doc_id", "product_type"],
            )

    return documents.select("doc_pos", "doc_id", "product_type", "body").mapInArrow(
        find, "qid bigint, doc_pos bigint, doc_id string, product_type string"
    )
