"""From a sentence to rows: an injected model client gives the intent, the compiler the plan."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Callable

from pyspark.errors import PySparkException

from annalist.model import Model
from annalist.plans.intent import Answer, Unsupported, answer
from annalist.sinks import log_training_example
from annalist.sources.intents import fill_template, find_json, read_intents, unwrap


@dataclasses.dataclass
class Reply:
    status: str  # success, failed or unavailable
    source: str | None
    answer: Answer | None
    reason: str | None = None


def ask(model: Model, sentence: str, client: Callable[[str], str] | None = None, template: str = "{{SENTENCE}}", fallback: Callable[[dict], Answer] | None = None, policy: str = "composer", limit: int = 200, log: str | None = None) -> Reply:
    """policy: composer (the compiler only), model (the fallback only) or both (the fallback where the compiler can't)."""
    if client is None:
        raise Unsupported("no model client is configured")
    prompt = fill_template(template, {"SENTENCE": sentence})
    completion = client(prompt)
    found = find_json(completion)
    if found is None:
        reply = Reply("failed", None, None, "no intent in the model's answer")
    else:
        reply = compose(model, unwrap(found)[1], fallback, policy, limit)
    if log:
        log_reply(log, prompt, completion, reply)
    return reply


def plan_text(found: Answer | None) -> str | None:
    """The optimised plan of an answer, which stands where a SQL engine has its statement."""
    return None if found is None else found.rows._jdf.queryExecution().optimizedPlan().toString()


def run_status(found: Answer | None) -> tuple[str, str | None, int | None]:
    """(success, failed or unavailable; error; rows) of running an answer."""
    if found is None:
        return "unavailable", None, None
    try:
        return "success", None, found.rows.count()
    except PySparkException as e:
        return "failed", str(e), None


def log_reply(log: str, prompt: str, completion: str, reply: Reply, gold: Answer | None = None, name: str | None = None) -> dict:
    status, error, rows = run_status(reply.answer)
    made = gold or (reply.answer if reply.source == "composer" else None)
    return log_training_example(log, prompt, completion, model=name, sql=plan_text(reply.answer), sql_source=reply.source, gold_sql=plan_text(made), db_status=status, db_error=error or reply.reason, row_count=rows)


def train_step(model: Model, folder: str, log: str, client: Callable[[str], str] | None = None, template: str = "{{INTENT}}", fallback: Callable[[dict], Answer] | None = None, policy: str = "composer", limit: int = 200, max_files: int | None = None) -> list[dict]:
    """The second stage over a folder of intents, one by one, each logged as an example; files without JSON are skipped. With
    policy `both` the compiler's plan is logged as the target beside the fallback's. The template is filled once per file."""
    out = []
    for _, _, intent in read_intents(folder, max_files):
        prompt = fill_template(template, {"INTENT": json.dumps(intent, ensure_ascii=False)})
        completion = client(prompt) if client else ""
        gold = None
        if policy == "both":
            try:
                gold = answer(model, intent, limit)
            except Unsupported:
                gold = None
        out.append(log_reply(log, prompt, completion, compose(model, intent, fallback, policy, limit), gold))
    return out


def compose(model: Model, intent: dict, fallback: Callable[[dict], Answer] | None = None, policy: str = "composer", limit: int = 200) -> Reply:
    reason = None
    if policy in ("composer", "both"):
        try:
            return Reply("success", "composer", answer(model, intent, limit))
        except Unsupported as e:
            reason = str(e)
    if policy in ("model", "both") and fallback is not None:
        return Reply("success", "model", fallback(intent))
    return Reply("unavailable", None, None, reason or "no fallback is configured")
