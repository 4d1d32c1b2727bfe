"""The catalogue of model providers, and the registry of bots."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Id, name, group and models of each provider.
PROVIDERS = [
    ("anthropic", "Anthropic", "AI-модели", ["claude-opus-4", "claude-sonnet-4", "claude-haiku-4.5"]),
    ("openai", "OpenAI", "AI-модели", ["gpt-5", "gpt-5-nano", "gpt-4o"]),
    ("google", "Google", "AI-модели", ["gemini-2-5-pro", "gemini-2-5-flash"]),
    ("x-ai", "xAI", "AI-модели", ["grok-4", "grok-3"]),
    ("deepseek", "DeepSeek", "AI-модели", ["deepseek-v4-pro", "deepseek-v3", "deepseek-r1"]),
    ("mistral", "Mistral AI", "AI-модели", ["mistral-large", "mistral-medium", "mixtral-8x7b"]),
    ("moonshot", "Moonshot AI", "AI-модели", ["kimi-k2", "moonshot-v1"]),
    ("minimax", "MiniMax", "AI-модели", ["minimax-m2.1"]),
    ("meta", "Meta", "AI-модели", ["llama-3.1-405b", "llama-3-70b", "codellama-70b"]),
    ("cohere", "Cohere", "AI-модели", ["command-r-plus", "command-r"]),
    ("zhipu", "Zhipu GLM", "AI-модели", ["glm-4.6", "glm-4-plus"]),
    ("qwen", "Qwen (Алибаба)", "AI-модели", ["qwen-2.5-72b", "qwen-coder"]),
    ("baidu", "Baidu ERNIE", "AI-модели", ["ernie-4.0", "ernie-bot"]),
    ("perplexity", "Perplexity", "AI-модели", ["sonar", "sonar-pro"]),
    ("databricks", "Databricks", "AI-модели", ["dbrx", "llama-3"]),
    ("ai21", "AI21 Labs", "AI-модели", ["jamba-1.5", "jurassic-2"]),
    ("writer", "Writer", "AI-модели", ["palmyra-x"]),
    ("gigachat", "GigaChat", "AI-модели", ["gigachat-max"]),
    ("sber", "Сбер", "AI-модели", ["gigachat-pro"]),
    ("abacus", "Abacus AI", "AI-модели", ["gpt-4", "claude-3"]),
    ("apple", "Apple", "AI-модели", ["openelm-3b"]),
    ("groq", "Groq", "Инфраструктура", ["llama-3.1", "mixtral-8x7b"]),
    ("cerebras", "Cerebras", "Инфраструктура", ["qwen-3-coder-480b"]),
    ("fireworks", "Fireworks AI", "Инфраструктура", ["kimi-k2-instruct"]),
    ("together", "Together AI", "Инфраструктура", ["llama-3.1-405b", "qwen-2.5-72b"]),
    ("baseten", "Baseten", "Инфраструктура", ["kimi-k2-instruct"]),
    ("nvidia", "NVIDIA NIM", "Инфраструктура", ["nemotron-3-super-120b", "nemotron-mixture"]),
    ("huggingface", "Hugging Face", "Инфраструктура", ["kimi-k2-instruct", "glm-4.6"]),
    ("deepinfra", "Deep Infra", "Инфраструктура", ["llama", "qwen"]),
    ("nebius", "Nebius Token Factory", "Инфраструктура", ["kimi-k2-instruct"]),
    ("gmi", "GMI Cloud", "Инфраструктура", ["llama", "qwen"]),
    ("iotnet", "IO.NET", "Инфраструктура", ["llama", "qwen", "deepseek"]),
    ("cortecs", "Cortecs", "Инфраструктура", ["kimi-k2-instruct"]),
    ("frogbot", "FrogBot", "Инфраструктура", ["llama"]),
    ("venice", "Venice AI", "Инфраструктура", ["llama", "qwen"]),
    ("poolside", "Poolside", "Инфраструктура", ["poolside"]),
    ("za", "Z.AI", "Инфраструктура", ["z-ai"]),
    ("modal", "Modal", "Инфраструктура", ["endpoints"]),
    ("302ai", "302.AI", "Инфраструктура", ["gpt", "claude", "gemini"]),
    ("amazon", "Amazon Bedrock", "Облака и шлюзы", ["claude", "llama", "mistral"]),
    ("azure", "Azure OpenAI", "Облака и шлюзы", ["gpt-4o", "gpt-35"]),
    ("azure-cognitive", "Azure Cognitive Services", "Облака и шлюзы", ["openai", "phi"]),
    ("google-vertex", "Google Vertex AI", "Облака и шлюзы", ["gemini"]),
    ("digitalocean", "DigitalOcean", "Облака и шлюзы", ["llama", "qwen", "deepseek"]),
    ("openrouter", "OpenRouter", "Облака и шлюзы", ["300+ моделей"]),
    ("github-copilot", "GitHub Copilot", "Облака и шлюзы", ["gpt", "claude"]),
    ("gitlab-duo", "GitLab Duo", "Облака и шлюзы", ["claude-haiku-4.5", "claude-sonnet-4.5", "claude-opus-4.5"]),
    ("ollama-cloud", "Ollama Cloud", "Облака и шлюзы", ["gpt-oss-20b-cloud"]),
    ("vercel", "Vercel AI Gateway", "Облака и шлюзы", ["gpt", "claude"]),
    ("cloudflare", "Cloudflare AI Gateway", "Облака и шлюзы", ["gpt-4o", "claude"]),
    ("cloudflare-ai", "Cloudflare Workers AI", "Облака и шлюзы", ["workers-ai"]),
    ("helicone", "Helicone", "Облака и шлюзы", ["routing"]),
    ("llm-gateway", "LLM Gateway", "Облака и шлюзы", ["gpt", "claude"]),
    ("zenmux", "ZenMux", "Облака и шлюзы", ["routing"]),
    ("stackit", "STACKIT", "Облака и шлюзы", ["llama"]),
    ("ovhcloud", "OVHcloud AI Endpoints", "Облака и шлюзы", ["llama", "mistral"]),
    ("sap", "SAP AI Core", "Облака и шлюзы", ["sap-ai"]),
    ("snowflake", "Snowflake Cortex", "Облака и шлюзы", ["cortex"]),
    ("scaleway", "Scaleway", "Облака и шлюзы", ["llama", "qwen"]),
    ("opencode-zen", "OpenCode Zen", "Облака и шлюзы", ["zen"]),
    ("ollama", "Ollama", "Локальные", ["llama-3", "mistral", "qwen-2", "gpt-oss"]),
    ("lmstudio", "LM Studio", "Локальные", ["gemma-3n-4b", "локальные-gguf"]),
    ("llamacpp", "llama.cpp", "Локальные", ["qwen3-coder-a3b", "gguf"]),
    ("atomic-chat", "Atomic Chat", "Локальные", ["openapi-совместимая"]),
    ("vllm", "vLLM", "Локальные", ["openai-совместимая"]),
    ("localai", "LocalAI", "Локальные", ["llama", "gpt4all"]),
    ("textgen", "oobabooga", "Локальные", ["llama", "mistral"]),
    ("petals", "Petals", "Локальные", ["bloom-176b"]),
]
PROVIDER = "id string, name string, group string, models array<string>"
BOT = "name string, platform string, commands array<string>"
DEFAULT_COMMANDS = ("/help",)


def provider_rows() -> list[tuple[str, str, str, list[str]]]:
    return [*PROVIDERS]


def _contains(query: Column) -> Column:
    return F.contains(F.lower(F.concat_ws(" ", "name", "id", F.array_join("models", " "))), F.lower(F.trim(query)))


def matching(queries: DataFrame) -> DataFrame:
    """(query, id, name, group, models) of the providers that each of many queries(query) finds. The catalogue has a fixed, small number of rows."""
    rows = queries.sparkSession.createDataFrame(PROVIDERS, PROVIDER)
    return queries.select("query").where("trim(query) != ''").join(F.broadcast(rows), _contains(F.col("query")))


def providers(spark: SparkSession, group: str | None = None, query: str | None = None) -> DataFrame:
    """Providers of a group whose name, id or models contain the query; case does not count."""
    rows = spark.createDataFrame(PROVIDERS, PROVIDER)
    if group and group.strip():
        rows = rows.where(F.lower("group") == group.strip().lower())
    if query and query.strip():
        rows = rows.where(_contains(F.lit(query)))
    return rows


def clean_bots(bots: DataFrame) -> DataFrame:
    """Of the rows (ord, name, platform, commands) the last of each trimmed name, in the order of first registration; commands trimmed, distinct, not empty. Rows without a name go."""
    tidy = bots.select("ord", F.trim("name").alias("name"), "platform", F.array_distinct(F.filter(F.transform("commands", lambda c: F.trim(c)), lambda c: c != "")).alias("commands")).where("name != ''")
    return tidy.groupBy("name").agg(F.min("ord").alias("ord"), F.max_by(F.struct("platform", "commands"), "ord").alias("last")).select("ord", "name", "last.platform", "last.commands")


class BotRegistry:
    """Bots by name. Registering a name again replaces what it had, in its place."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._rows: dict[str, tuple[str, str, list[str]]] = {}

    def register(self, name: str, platform: str, commands: Iterable[str] | None = None) -> tuple[str, str, list[str]]:
        name = name.strip()
        if not name:
            raise ValueError("a bot needs a name")
        kept = dict.fromkeys(c.strip() for c in (DEFAULT_COMMANDS if commands is None else commands))
        self._rows[name] = (name, platform, [c for c in kept if c])
        return self._rows[name]

    def get(self, name: str) -> tuple[str, str, list[str]] | None:
        return self._rows.get(name)

    def remove(self, name: str) -> bool:
        return self._rows.pop(name, None) is not None

    def list(self) -> DataFrame:
        return self.spark.createDataFrame([*self._rows.values()], BOT)
