"""Text retrieval and question answering as Spark DataFrame plans."""

from trovelake.plans.answers import AnswerPipeline, AnswerResponse

__all__ = ["AnswerPipeline", "AnswerResponse"]
