"""JSON functions: log events, reviewer answers and review prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, blank, or_null, strip

#: Known noise in logs and what is shown instead.
NOISE = [
    ("Failed to create shell snapshot", "A preparar o ambiente de trabalho"),
    ("prompt must be at most 128 characters", "A carregar definições de plugin"),
    ("icon path must not contain '..'", "A validar recursos dos plugins"),
    ("GITHUB_PAT_TOKEN for MCP server 'github' is not set", "Ligação a integrações opcionalmente indisponível"),
]
NOISE_STARTS = [("Reading prompt from stdin", "A receber o briefing"), ("SUCCESS: The process", "Processo anterior encerrado")]
APPROVED, REJECTED = "Aprovada pela IA.", "Rejeitada pela IA."
PROMPT_HEAD = "Check whether this business contact fits the request. Answer with JSON only:"
PROMPT_SHAPE = '{"approved":true|false,"reason":"","issues":[""],"normalized":{}}'
PROMPT_RULE = "Approve a real business of that type and place with a public phone or e-mail; reject portals, categories and platforms. Don't invent data."
INCONCLUSIVE = "Validador AI inconclusivo; validação local aplicada."


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def describe_event(line: Column) -> Column:
    """A readable message of a JSON log line; other text as it is, blank lines null."""
    text = strip(line)
    v = F.try_parse_json(text)
    kind, item = _get(v, "$.type"), _get(v, "$.item.type")
    named = lambda path, default: F.coalesce(or_null(_get(v, path)), F.lit(default))
    thread = or_null(_get(v, "$.thread_id"))
    snippet = F.regexp_replace(strip(_get(v, "$.item.text")), f"[{WS}]+", " ")
    query = F.coalesce(or_null(_get(v, "$.item.action.query")), or_null(_get(v, "$.item.query")))
    # fixed values
    started = F.when(item == "web_search", "A pesquisar na web").when(item == "shell_command", "A preparar ficheiros locais").otherwise(F.concat(F.lit("A trabalhar ("), named("$.item.type", "tarefa"), F.lit(")")))
    completed = (
        F.when(item == "agent_message", F.coalesce(or_null(F.substring(snippet, 1, 180)), F.lit("Mensagem pronta")))
        .when(item == "web_search", F.coalesce(F.concat(F.lit("Pesquisa concluída: "), query), F.lit("Pesquisa concluída")))
        .when(item == "function_call", F.concat(F.lit("Ferramenta: "), named("$.item.name", "desconhecida")))
        .otherwise(F.concat(F.lit("Item concluído ("), named("$.item.type", "desconhecido"), F.lit(")")))
    )
    message = or_null(_get(v, "$.message"))
    told = (
        F.when(kind == "thread.started", F.concat(F.lit("Thread iniciada"), F.coalesce(F.concat(F.lit(" ("), thread, F.lit(")")), F.lit(""))))
        .when(kind == "turn.started", "Codex a pensar")
        .when(kind == "item.started", started)
        .when(kind == "item.completed", completed)
        .when(kind == "turn.completed", "Codex terminou o turno")
        .when(kind == "error", F.coalesce(message, or_null(_get(v, "$.error")), text))
        .otherwise(F.coalesce(message, text))
    )
    return F.when(text == "", F.lit(None)).when(text.startswith("{") & v.isNotNull(), told).otherwise(text)


def humanize(line: Column) -> Column:
    """Known noise gives way to a short message; blank lines are null."""
    text = strip(line)
    out = F.when(text == "", F.lit(None))
    for part, message in NOISE:
        out = out.when(text.contains(part), message)
    for start, message in NOISE_STARTS:
        out = out.when(text.startswith(start), message)
    return out.otherwise(text)


def log_messages(chunk: Column, most: int = 2) -> Column:
    """The first messages of a chunk of log lines."""
    lines = F.filter(F.transform(F.split(blank(chunk), r"\r?\n"), strip), lambda x: x != "")
    return F.slice(F.filter(F.transform(lines, lambda x: humanize(describe_event(x))), lambda x: x.isNotNull()), 1, most)


def review_text(stdout: Column) -> Column:
    """The reviewer's last message of its JSON lines; else the last line."""
    lines = F.filter(F.transform(F.split(blank(stdout), r"\r?\n"), strip), lambda x: x != "")

    def candidate(line: Column) -> Column:
        v = F.try_parse_json(line)
        said = F.when(_get(v, "$.item.type").isin("agent_message", "assistant_message"), or_null(strip(_get(v, "$.item.text"))))
        return F.when(v.isNotNull(), said).when(line.startswith("{") & line.endswith("}"), line)

    found = F.filter(F.transform(lines, candidate), lambda x: x.isNotNull())
    return F.coalesce(F.try_element_at(found, F.lit(-1)), F.try_element_at(lines, F.lit(-1)), F.lit(""))


def review_payload(text: Column) -> Column:
    """The answer as a variant: fenced or bare JSON, else the widest braces; null if there is none."""
    bare = strip(F.regexp_replace(F.regexp_replace(strip(text), "(?i)^```(?:json)?", ""), "```$", ""))
    return F.coalesce(F.try_parse_json(or_null(bare)), F.try_parse_json(or_null(F.regexp_extract(bare, r"(?s)(\{.*\})", 1))))


def to_verdict(payload: Column) -> Column:
    """approved, reason, issues and normalized of an answer; what is no object approves, as inconclusive."""
    kind = F.schema_of_variant(payload)
    structured = payload.isNotNull() & (kind.startswith("OBJECT") | kind.startswith("ARRAY"))
    approved = F.coalesce(_get(payload, "$.approved", "boolean"), ~F.coalesce(_get(payload, "$.approved"), F.lit("")).isin("", "0", "false"))
    reason = F.coalesce(or_null(strip(_get(payload, "$.reason"))), F.when(approved, APPROVED).otherwise(REJECTED))
    issues = F.coalesce(F.try_variant_get(payload, "$.issues", "array<string>"), F.array().cast("array<string>"))
    normalized = F.try_variant_get(payload, "$.normalized", "map<string,string>")
    return F.struct(
        F.when(structured, approved).otherwise(True).alias("approved"),
        F.when(structured, reason).otherwise(INCONCLUSIVE).alias("reason"),
        F.when(structured, issues).otherwise(F.array().cast("array<string>")).alias("issues"),
        F.when(structured, normalized).alias("normalized"),
    )


def review_prompt(lead_type: Column, geography: Column, source: Column, row: Column) -> Column:
    """A prompt for offline review of one row: what is asked for, the form of the answer and the row as JSON."""
    return F.concat_ws(
        "\n",
        F.lit(PROMPT_HEAD),
        F.lit(PROMPT_SHAPE),
        F.concat(F.lit("Requested business type: "), blank(lead_type)),
        F.concat(F.lit("Requested geography: "), blank(geography)),
        F.concat(F.lit("Source context: "), F.coalesce(or_null(blank(source)), F.lit("unknown"))),
        F.lit(PROMPT_RULE),
        F.lit("Lead JSON:"),
        F.to_json(row, {"pretty": "true"}),
    )
