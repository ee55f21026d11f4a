"""Column functions over messages, turns, headers and streamed responses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REDACTED = "REDACTED"
#: Header names (fixed values) whose contents are never kept.
SECRET_HEADERS = ("authorization", "x-api-key", "cookie", "set-cookie", "proxy-authorization")
#: Openings (fixed values) of texts that a harness puts in, not a person.
INJECTIONS = (r"\AThe user stepped away and is coming back\b", r"\A\[SUGGESTION MODE:")
REMINDER = r"(?s)<system-reminder>.*?</system-reminder>\s*"
#: Phrases (fixed values) that refer to the conversation itself; the first that matches counts.
META_REFERENCES = (
    r"(?i)\b(see|saw|read) above\b(?!\s*\d)",
    r"(?i)\bcontinue from (here|where we left off)\b",
    r"(?i)\bredo (your|my) (last|previous) (answer|response|message|reply)\b",
    r"(?i)\bthe (last|previous) (question|answer|message|response) I (asked|gave|sent)\b",
)
MAX_LABEL_BYTES = 256


def classify(stop_reason: Column) -> Column:
    """Whether a finished turn can be forked, from why its response stopped."""
    return F.when(stop_reason.isin("end_turn", "stop_sequence"), "closed_forkable").when(stop_reason.isin("tool_use", "pause_turn"), "open").otherwise("dangling_unforkable")


def turn_kind(stop_reason: Column) -> Column:
    return F.when(stop_reason == "rewind_synthetic", "rewind_marker").when(stop_reason == "submit_synthetic", "submit_marker").otherwise("turn")


def branch_kind(auto_label: Column) -> Column:
    return F.when(auto_label.startswith("fork@"), "fork_point").otherwise("bookmark")


def squeezed(text: Column) -> Column:
    """White space runs as one blank, trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def truncated(text: Column, most: int = 100) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 1)), F.lit("…"))).otherwise(text)


def is_injection(text: Column) -> Column:
    """Texts of a harness: known openings, or nothing but reminder blocks."""
    opening = text.rlike(INJECTIONS[0]) | text.rlike(INJECTIONS[1])
    only = text.startswith("<system-reminder>") & (F.trim(F.regexp_replace(text, REMINDER, "")) == "")
    return F.coalesce(opening | only, F.lit(False))


def meta_reference(text: Column) -> Column:
    """1-based number of the first phrase that refers to the conversation; null if none does."""
    out = F.lit(None).cast("int")
    for k, pattern in reversed(list(enumerate(META_REFERENCES, 1))):
        out = F.when(text.rlike(pattern), F.lit(k)).otherwise(out)
    return out


def anchor_token(text: Column) -> Column:
    """The token of the first anchor tag, its quotes escaped or not; null if there is none."""
    found = F.regexp_extract(text, r"<[a-z]+-anchor token=\\?\"(tok_[0-9a-f]{12})\\?\"\s*/>", 1)
    return F.when(found != "", found)


def clean_label(label: Column) -> Column:
    """A label without control characters; null where it is empty or over the byte limit."""
    out = F.trim(F.regexp_replace(label, r"[\x00-\x1F\x7F]", ""))
    return F.when((out != "") & (F.octet_length(out) <= MAX_LABEL_BYTES), out)


def redacted(headers: Column, more: tuple[str, ...] = ()) -> Column:
    """A header map with secret values replaced; names compare without regard to case."""
    names = F.array(*(F.lit(x.strip().lower()) for x in (*SECRET_HEADERS, *more) if x.strip()))
    return F.transform_values(headers, lambda k, v: F.when(F.array_contains(names, F.lower(k)), F.lit(REDACTED)).otherwise(v))


def redacted_lists(headers: Column, more: tuple[str, ...] = ()) -> Column:
    """The same for a map of lists: each element is replaced."""
    names = F.array(*(F.lit(x.strip().lower()) for x in (*SECRET_HEADERS, *more) if x.strip()))
    return F.transform_values(headers, lambda k, v: F.when(F.array_contains(names, F.lower(k)), F.transform(v, lambda _: F.lit(REDACTED))).otherwise(v))


def message_text(content: Column) -> Column:
    """Text blocks of ``array<struct<type, text>>`` joined by line feeds."""
    return F.array_join(F.transform(F.filter(content, lambda b: (b.type == "text") & b.text.isNotNull()), lambda b: b.text), "\n")


def json_message_text(content: Column) -> Column:
    """Text of JSON content: a string as it is, or its text blocks joined by line feeds; otherwise empty."""
    blocks = F.from_json(content, "array<struct<type:string,text:string>>")
    return F.when(content.startswith("["), F.coalesce(message_text(blocks), F.lit(""))).when(content.startswith('"'), F.from_json(F.concat(F.lit('{"x":'), content, F.lit("}")), "x string")["x"]).otherwise(F.lit(""))


def sse_events(body: Column) -> Column:
    """JSON texts of a server-sent event stream: data lines of each frame joined by line feeds."""
    frames = F.split(F.regexp_replace(body, "\r\n?", "\n"), "\n\n+")
    lines = lambda f: F.filter(F.split(f, "\n"), lambda x: x.startswith("data:"))
    joined = F.transform(frames, lambda f: F.array_join(F.transform(lines(f), lambda x: F.regexp_replace(x, r"\Adata: ?", "")), "\n"))
    return F.filter(joined, lambda x: x != "")


def sse_stop_reason(body: Column) -> Column:
    """The last stop reason that message_delta events name before message_stop."""
    events = F.transform(sse_events(body), lambda x: F.struct(F.get_json_object(x, "$.type").alias("kind"), F.get_json_object(x, "$.delta.stop_reason").alias("stop")))

    def last(found: Column) -> Column:
        end = F.array_position(F.transform(found, lambda x: x.kind), F.lit("message_stop"))
        upto = F.slice(found, F.lit(1), F.when(end > 0, end.cast("int")).otherwise(F.size(found)))
        return F.get(F.reverse(F.filter(upto, lambda x: (x.kind == "message_delta") & x.stop.isNotNull())), F.lit(0)).getField("stop")

    # A lambda's variable stands for the parsed events, so that they are parsed once.
    return F.get(F.transform(F.array(events), last), F.lit(0))


def json_stop_reason(body: Column) -> Column:
    """The top-level stop_reason of a JSON body where it is a string, else null."""
    typed = F.try_variant_get(F.try_parse_json(body), "$.stop_reason", "string")
    return F.when(F.schema_of_variant(F.try_variant_get(F.try_parse_json(body), "$.stop_reason", "variant")) == "STRING", typed)


def turn_preview(messages: Column, most: int = 100) -> Column:
    """struct(user, prior_assistant) of ``array<struct<role, text>>``: the last user text that no
    harness put in (else the last of those), and the nearest earlier assistant text."""
    at = F.transform(messages, lambda m, i: F.struct(i.alias("i"), m.role.alias("role"), squeezed(m.text).alias("text")))
    users = F.filter(at, lambda m: (m.role == "user") & (m.text != ""))
    real = F.filter(users, lambda m: ~is_injection(m.text))
    user = F.coalesce(F.get(F.reverse(real), F.lit(0)), F.get(F.reverse(users), F.lit(0)))
    prior = F.get(F.reverse(F.filter(at, lambda m: (m.role == "assistant") & (m.text != "") & (m.i < user.i))), F.lit(0))
    return F.struct(truncated(user.text, most).alias("user"), truncated(prior.text, most).alias("prior_assistant"))


def spliced(messages: Column, target: Column, anchor: Column) -> Column:
    """The target's messages, then those after position ``anchor`` (0-based); as they are where it is null."""
    rest = F.slice(messages, anchor.cast("int") + 2, F.greatest(F.size(messages) - anchor.cast("int") - 1, F.lit(0)))
    return F.when(anchor.isNull(), messages).otherwise(F.concat(target, rest))


def last_position(messages: Column, test) -> Column:
    """0-based position of the last element that fits, null if none does."""
    found = F.filter(F.transform(messages, lambda m, i: F.when(test(m), i)), lambda i: i.isNotNull())
    return F.get(F.reverse(found), F.lit(0))


def reminded(messages: Column, reminder: Column) -> Column:
    """``reminder`` in front of the last user message's text."""
    last = last_position(messages, lambda m: m.role == "user")
    return F.transform(messages, lambda m, i: F.when(i == last, F.struct(m.role.alias("role"), F.concat(reminder, F.lit("\n"), m.text).alias("text"))).otherwise(F.struct(m.role.alias("role"), m.text.alias("text"))))


def trimmed_to_assistant(messages: Column) -> Column:
    """Messages up to the last assistant's; none where there is no such message."""
    last = last_position(messages, lambda m: m.role == "assistant")
    return F.slice(messages, F.lit(1), F.coalesce(last + 1, F.lit(0)).cast("int"))


def capped_markers(markers: Column, protected: Column, most: int = 4) -> Column:
    """Which message markers stay (array of booleans): the latest, up to ``most`` with the protected ones."""
    room = F.greatest(F.lit(most) - protected, F.lit(0))
    return F.transform(markers, lambda _, i: i >= F.size(markers) - room)


def ttl_violations(ttls: Column) -> Column:
    """Which markers (array of "5m" / "1h" in processing order) must go: short ones before the last long one."""
    last = F.coalesce(F.array_max(F.transform(ttls, lambda t, i: F.when(t == "1h", i))), F.lit(-1))
    return F.transform(ttls, lambda t, i: (F.coalesce(t, F.lit("5m")) == "5m") & (i < last))
