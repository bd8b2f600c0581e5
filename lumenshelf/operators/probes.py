"""What a search would find if constraints were given up, all from one scan, and a planner's loop over these numbers.

Each row that meets the hard conditions gets a bitmask of the constraints it misses. Rows are counted by mask, with the lowest
price; a set of dropped constraints then finds the rows whose mask lies within it, so the sums over all subsets of each mask
give the numbers of every combination. An intent has at most ten soft constraints: at most 1,024 masks and combinations.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import DISTINCTIVE, Intent, given, hard, soft
from .recommend import ENOUGH, RELAX, Choice, Level, ladder, level_filter, levels

RELAXABLE = [c for c in RELAX if c != "color"]
ROUNDS = len(RELAXABLE) + 2


def missed(df: DataFrame, intent: Intent) -> DataFrame:
    """(mask, n, lifted, cheapest): of the rows in question by the constraints that they miss, how many fit the budget, how many there
    are, and the lowest price of all. One scan; what is grouped has at most a row for each mask and task."""
    mask = sum((F.when(c, 0).otherwise(1 << i) for i, c in enumerate(soft(intent).values())), F.lit(0))
    within = F.col("price") <= intent.max_budget if intent.max_budget > 0 else F.lit(True)
    rows = df.where(hard(intent, budget=False)).select(mask.alias("mask"), "price", F.coalesce(within, F.lit(False)).alias("within"))
    return rows.groupBy("mask").agg(F.count_if("within").alias("n"), F.count(F.lit(1)).alias("lifted"), F.min("price").alias("cheapest"))


def probes(df: DataFrame, intent: Intent) -> DataFrame:
    """(mask, dropped, n, lifted, cheapest) of every combination of dropped constraints: matches within the budget, matches at any
    price, and the lowest price of these. Combinations that find nothing at any price aren't listed."""
    names = list(soft(intent))
    out = missed(df, intent)
    for i in range(len(names)):  # a mask counts for every set that holds it
        bit = 1 << i
        out = out.withColumn("mask", F.explode(F.when(F.col("mask").bitwiseAND(bit) == 0, F.array("mask", F.col("mask") + bit)).otherwise(F.array("mask"))))
    summed = out.groupBy("mask").agg(F.sum("n").alias("n"), F.sum("lifted").alias("lifted"), F.min("cheapest").alias("cheapest"))
    dropped = F.array_compact(F.array(*(F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.lit(c)) for i, c in enumerate(names)))) if names else F.array().cast("array<string>")
    return summed.select("mask", dropped.alias("dropped"), "n", "lifted", "cheapest")


class Counts:
    """The numbers of all combinations, on the driver (at most 1,024 rows)."""

    def __init__(self, df: DataFrame, intent: Intent):
        self.bit = {c: 1 << i for i, c in enumerate(soft(intent))}
        self.rows = {r["mask"]: (r["n"], r["lifted"], r["cheapest"]) for r in probes(df, intent).select("mask", "n", "lifted", "cheapest").collect()}

    def at(self, dropped: Iterable[str], color: str) -> tuple[int, int, float | None]:
        """(matches, matches at any price, lowest price) without the dropped constraints; color: exact, family or none."""
        loose = {*dropped, *(f"color_{c}" for c in ("exact", "family") if c != color)}
        return self.rows.get(sum(self.bit.get(c, 0) for c in loose), (0, 0, None))


@dataclass(frozen=True)
class Offer:
    """What a planner gets to see in a round."""

    active: list[str]
    dropped: list[str]
    current: int
    target: int
    options: dict[str, int]  # label -> matches once that constraint is given up
    max_budget: float
    lifted: int | None
    cheapest: float | None
    round: int


@dataclass(frozen=True)
class Move:
    """relax (with the label of an option), accept, stop or raise_budget"""

    action: str
    constraint: str = ""
    message: str | None = None


@dataclass(frozen=True)
class Outcome:
    choice: Choice
    message: str | None = None
    trace: list[Move] = field(default_factory=list)


def label(intent: Intent, c: str) -> str:
    told = {
        "neckline": intent.neckline, "pieces": f"{intent.pieces}-piece" if intent.pieces else "piece count", "print": intent.print or "print/work", "dress_style": intent.dress_style or "dress style",
        "occasion": "/".join(intent.occasion), "color": intent.color_exact or "/".join(intent.color_families) or "colour",
    }
    return told.get(c, getattr(intent, c, None)) or c


class _Walk:
    """The constraints given up so far."""

    def __init__(self, counts: Counts, intent: Intent):
        self.counts, self.intent, self.has = counts, intent, set(given(intent))
        self.color = next((m for m in ("exact", "family") if f"color_{m}" in self.has), "none")
        self.dropped: list[str] = []
        self.told: list[str] = []

    @property
    def now(self) -> tuple[int, int, float | None]:
        return self.counts.at(self.dropped, self.color)

    @property
    def wider(self) -> str:
        return "family" if self.color == "exact" and "color_family" in self.has else "none"

    def left(self) -> dict[str, int]:
        """Matches once each constraint that is left is given up, too."""
        return {c: self.counts.at([*self.dropped, c], self.color)[0] for c in RELAXABLE if c in self.has and c not in self.dropped}

    def widened(self) -> int | None:
        return None if self.color == "none" else self.counts.at(self.dropped, self.wider)[0]

    def drop(self, c: str) -> None:
        self.dropped.append(c)
        self.told.append(c)

    def widen(self) -> None:
        self.color = self.wider
        self.told.append("exact color" if self.color == "family" else "color")

    def best_other(self, more_than: int) -> str | None:
        """The constraint that frees most rows; never the style."""
        options = {c: n for c, n in self.left().items() if c != "dress_style" and n > more_than}
        return max(options, key=options.get, default=None)

    def choice(self) -> Choice:
        return Choice(Level(tuple(self.dropped), self.color, None), tuple(self.told), None)

    def offer(self, target: int, turn: int) -> Offer:
        left, wide = self.left(), self.widened()
        shown = {label(self.intent, c): n for c, n in left.items()} | ({f"colour ({label(self.intent, 'color')})": wide} if wide is not None else {})
        active = ([label(self.intent, "color")] if wide is not None else []) + [label(self.intent, c) for c in left]
        n, lifted, cheapest = self.now
        asked = self.intent.max_budget > 0
        return Offer(active, list(self.told), n, target, shown, self.intent.max_budget, lifted if asked else None, cheapest if asked else None, turn)


NOTHING = "Nothing matches the request, even with every filter relaxed that could be."


def plan(df: DataFrame, intent: Intent, planner: Callable[[Offer], Move | None], least: int = 1, rounds: int = ROUNDS) -> Outcome:
    """Gives constraints up one by one, as the planner says, until `least` rows match. Without an answer the ladder decides. A
    planner that accepts too few rows is overruled while another constraint, or the colour, would free more; a distinctive style
    stays as long as anything else can go. The table is scanned once, before the first round."""
    walk, trace = _Walk(Counts(df, intent), intent), []
    for turn in range(rounds):
        n = walk.now[0]
        if n >= least:
            return Outcome(walk.choice(), trace=trace)
        move = planner(walk.offer(least, turn))
        if move is None:
            found = {i: (walk.counts.at(r.dropped, r.color)[0], walk.counts.at(r.dropped, r.color)[2]) for i, r in enumerate(levels(intent))}
            return Outcome(ladder(found, intent, least), trace=trace)
        trace.append(move)
        if move.action == "raise_budget":
            blocked = (intent.max_budget, walk.now[2]) if walk.now[2] is not None else None
            return Outcome(Choice(None, tuple(walk.told), blocked), move.message, trace)
        if move.action in ("accept", "stop"):
            if n and (other := walk.best_other(n)):
                walk.drop(other)
            elif n and (walk.widened() or 0) > n:
                walk.widen()
            else:
                return Outcome(walk.choice() if n else Choice(None, tuple(walk.told), None), move.message if n else NOTHING, trace)
            continue
        wanted = move.constraint.lower()
        left = walk.left()
        target = next((c for c in left if label(intent, c).lower().split(" ")[0] in wanted), None)
        recolor = "colo" in wanted and walk.color != "none"
        if target == "dress_style" and intent.dress_style in DISTINCTIVE:
            if walk.widened():
                target, recolor = None, True
            elif other := walk.best_other(0):
                target = other
            elif n:
                return Outcome(walk.choice(), trace=trace)
        if recolor:
            walk.widen()
        elif target or left:
            walk.drop(target or next(iter(left)))
        elif walk.color != "none":
            walk.color = "none"
            walk.told.append("color")
        else:
            break
    return Outcome(walk.choice(), trace=trace)


def planned(df: DataFrame, intent: Intent, planner: Callable[[Offer], Move | None], least: int = ENOUGH) -> DataFrame:
    """The rows that the planner's choice finds."""
    found = plan(df, intent, planner, least).choice
    return df.where(level_filter(intent, found.level) if found.level else F.lit(False))
