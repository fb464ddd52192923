"""Results depend on them, so they are stated literally.

Everything here is data (word lists, texts, patterns, numeric defaults).  All of
it can be replaced per call through the operators' parameters.
"""

from __future__ import annotations

# --- numeric defaults --------------------------------------------------------
CHUNK_SIZE = 420
CHUNK_OVERLAP = 60
EMBEDDING_DIM = 384
BM25_K1 = 1.5
BM25_B = 0.75
TOP_K = 5
MMR_FETCH_K = 12
MMR_LAMBDA = 0.65
VECTOR_WEIGHT = 0.55
COMPRESS_MAX_CHARS = 520
MIN_RELEVANCE = 0.12
TEMPERATURE = 0.2
MAX_TOKENS = 500
HTTP_TIMEOUT_SECONDS = 60

CHUNK_STRATEGIES = ("size", "sentence", "recursive")
SEARCH_MODES = ("similarity", "mmr", "hybrid")
PRODUCT_TYPES = ("loan", "mortgage", "deposit", "borrower", "faq")
METADATA_COLUMNS = (
    "doc_id",
    "title",
    "product_type",
    "updated_at",
    "source",
    "section",
    "chunk_strategy",
    "chunk_index",
)

# --- patterns ----------------------------------------------------------------
CONTROL_CHARS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
TOKEN_PATTERN = "[a-zа-яё0-9%]+"
CITATION_PATTERN = r"\[([^\]]+)\]"

# Separators of the optional separator-based splitter, coarse to fine.
SPLIT_SEPARATORS = {
    "size": (" ", ""),
    "sentence": (". ", "? ", "! ", "\n", "; ", ", ", " ", ""),
    "recursive": ("\n\n", "\n", ". ", "? ", "! ", "; ", ", ", " ", ""),
}

# --- word lists --------------------------------------------------------------
# Product lexicon: declaration order decides ties.
PRODUCT_KEYWORDS = {
    "loan": ["кредит", "кредита", "кредиту", "потребительский", "удобный", "платеж", "погасить"],
    "mortgage": ["ипотека", "ипотеки", "ипотеку", "семейная", "недвижимость", "застройщик"],
    "deposit": ["вклад", "вклада", "вкладу", "депозит", "проценты", "капитализация", "пополнять"],
    "borrower": ["заемщик", "заемщика", "долговая", "доход", "гражданство", "отказ"],
    "faq": ["заявка", "статус", "уведомление", "приложение", "закрыть"],
}

# Query expansion: (trigger tokens, suffix appended to the question).
EXPANSION_RULES = [
    (["ставка", "процент", "проценты"], "процентная ставка тариф доходность"),
    (["документы", "паспорт", "снилс"], "документы паспорт СНИЛС подтверждение дохода"),
    (["досрочно", "закрыть", "погасить"], "досрочное погашение закрытие штраф комиссия"),
    (["возраст", "требования", "стаж"], "требования заемщик возраст стаж доход"),
]

# --- texts -------------------------------------------------------------------
FLAT_TYPE_LABEL = "Тип продукта: "
FLAT_SOURCE_LABEL = "Источник: "
ANSWER_SOURCES_LABEL = "Источники: "
VERIFIED_SOURCES_LABEL = "Проверенные источники: "
HISTORY_USER_LABEL = "Клиент: "
HISTORY_ASSISTANT_LABEL = " Консультант: "
HISTORY_QUESTION_LABEL = " Новый вопрос: "
PROMPT_CONTEXT_LABEL = "Контекст:\n"
PROMPT_QUESTION_LABEL = "\n\nВопрос клиента: "
NO_CONTEXT_ANSWER = (
    "Я не нашел релевантную информацию в базе знаний банка. "
    "Пожалуйста, уточните вопрос или обратитесь к специалисту банка."
)
LOW_RELEVANCE_ANSWER = (
    "Я не нашел релевантную информацию в актуальной базе знаний банка. "
    "Пожалуйста, уточните продукт или обратитесь к специалисту банка."
)
UNCERTAIN_ANSWER = (
    "В найденных документах есть связанная информация, "
    "но точный ответ требует уточнения у специалиста банка."
)
SYSTEM_PROMPT = (
    "Вы банковский консультант. Отвечайте кратко, вежливо и только на основе\n"
    "переданного контекста из базы знаний банка. Если в контексте нет ответа, скажите, что\n"
    "нужно уточнить информацию у специалиста банка. Не выдумывайте тарифы, ставки, сроки и\n"
    "требования. В конце ответа укажите источники в формате [SOURCE / SECTION]."
)
PERFORMANCE_QUESTION = "Какая ставка по семейной ипотеке?"

# --- model names and prefixes --------------------------------------------------
NEURAL_MODEL = "intfloat/multilingual-e5-large"
PASSAGE_PREFIX = "passage: "
QUERY_PREFIX = "query: "
OPENAI_MODEL = "gpt-4o-mini"
OLLAMA_MODEL = "llama3.1"
OLLAMA_ENDPOINT = "http://localhost:11434/api/chat"
