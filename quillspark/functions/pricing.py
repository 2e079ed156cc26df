"""Prices of calls, as column expressions; unknown Claude models have no price, unknown OpenAI ones the default."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# US dollars for a million tokens.
# family: input, output, cache read, cache write for 5 minutes, cache write for 1 hour
CLAUDE = {
    "claude-opus-": (5.00, 25.00, 0.50, 6.25, 10.00),
    "claude-sonnet-": (3.00, 15.00, 0.30, 3.75, 6.00),
    "claude-haiku-": (1.00, 5.00, 0.10, 1.25, 2.00),
    "claude-fable-": (10.00, 50.00, 1.00, 12.50, 20.00),
    "claude-mythos-": (10.00, 50.00, 1.00, 12.50, 20.00),
}
# model: from which day (UTC), input, cached input, output
OPENAI = {
    "gpt-6-astra": [("1970-01-01", 10.0, 1.0, 50.0)],
    "gpt-5.6-sol": [("1970-01-01", 5.0, 0.5, 30.0), ("2026-08-21", 4.0, 0.4, 20.0)],
    "gpt-5.6-terra": [("1970-01-01", 2.5, 0.25, 15.0), ("2026-07-30", 2.0, 0.2, 12.0)],
    "gpt-5.6-luna": [("1970-01-01", 1.0, 0.1, 6.0), ("2026-07-30", 0.2, 0.02, 1.2)],
    "gpt-5.5": [("1970-01-01", 5.0, 0.5, 30.0)],
    "gpt-5.4": [("1970-01-01", 2.5, 0.25, 15.0)],
}
OPENAI_DEFAULT = (5.0, 0.5, 30.0)
# model: more input tokens than these cost so many times the price: input, cached input, output
LONG_CONTEXT = {"gpt-6-astra": (272_000, 2.0, 2.0, 1.5)}
MILLION = 1_000_000


def claude_cost(model: Column, tokens: Column, output: Column, cache_creation: Column, cache_read: Column, cache_creation_1h: Column) -> Column:
    """Dollars, or null for a model of no known family. Tokens of the long cache are part of all cache tokens."""
    written = F.greatest(cache_creation, F.lit(0))
    hour = F.least(F.greatest(cache_creation_1h, F.lit(0)), written)
    short = F.greatest(cache_creation - hour, F.lit(0))
    out = F.lit(None).cast("double")
    for family, (a, b, c, d, e) in CLAUDE.items():
        out = F.when(F.startswith(model, F.lit(family)), (tokens * a + output * b + cache_read * c + short * d + hour * e) / MILLION).otherwise(out)
    return out


def openai_cost(model: Column, tokens: Column, cached: Column, output: Column, day: Column) -> Column:
    """Dollars by the rate of that day; cached tokens are part of the input. Models go by their name or its beginning."""
    name = F.lower(F.trim(F.coalesce(model, F.lit(""))))

    def cost(rate: tuple[float, float, float]) -> Column:
        a, b, c = rate
        # (divided once, so a price of few decimals is the double next to it)
        return (F.greatest(tokens - cached, F.lit(0)) * a + cached * b + output * c) / MILLION

    out = cost(OPENAI_DEFAULT)
    for key, changes in reversed(OPENAI.items()):
        price = cost(changes[0][1:])
        for since, *rate in changes[1:]:
            price = F.when(day.isNull() | (day >= F.lit(since).cast("date")), cost(tuple(rate))).otherwise(price)
        if key in LONG_CONTEXT:
            most, x, y, z = LONG_CONTEXT[key]
            a, b, c = changes[-1][1:]
            price = F.when(tokens > most, cost((a * x, b * y, c * z))).otherwise(price)
        out = F.when(F.startswith(name, F.lit(key)), price).otherwise(out)
    return out
