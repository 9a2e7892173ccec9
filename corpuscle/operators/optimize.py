"""0/1 knapsacks and selection among candidate solutions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions.folds import best_value, greedy_take


def density(v: Column, w: Column) -> Column:
    return v / F.greatest(F.lit(1), w)


def useful(items: DataFrame, capacity: int, w: str = "w", v: str = "v", item: str = "item_id") -> DataFrame:
    """Items that some best choice can hold: of one weight only the most valuable that fit together. Their number
    is bounded by the capacity, whatever the number of items; weightless items of value all stay, summed up."""
    order = Window.partitionBy(w).orderBy(F.desc(v), item)
    fits = items.where((F.col(w) > 0) & (F.col(w) <= capacity) & (F.col(v) > 0))
    top = fits.withColumn("_n", F.row_number().over(order)).where(F.col("_n") * F.col(w) <= capacity).select(item, w, v)
    free = items.where((F.col(w) == 0) & (F.col(v) > 0)).agg(F.min(item).alias(item), F.lit(0).cast("long").alias(w), F.sum(v).alias(v)).where(F.col(v).isNotNull())
    return top.unionByName(free)


def optimum(items: DataFrame, capacity: int) -> DataFrame:
    """(value): the largest value within the capacity, by a table over capacities."""
    rows = useful(items.select("item_id", F.col("w").cast("long").alias("w"), F.col("v").cast("long").alias("v")), capacity)
    lists = rows.agg(F.array_sort(F.collect_list(F.struct("w", "v", "item_id"))).alias("items"))
    return lists.select(best_value(F.col("items"), capacity).alias("value"))


def chosen_items(items: DataFrame, capacity: int) -> DataFrame:
    """(item_id, w, v): a choice of the largest value. Of choices of equal value one with later items of the useful
    ones by (w, v, item_id) left out. Weightless items of value are all chosen."""
    rows = useful(items.select("item_id", F.col("w").cast("long").alias("w"), F.col("v").cast("long").alias("v")), capacity).where("w > 0")
    lists = rows.agg(F.array_sort(F.collect_list(F.struct("w", "v", "item_id"))).alias("items"))

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for own in b["items"]:
                best, taken = np.zeros(capacity + 1, np.int64), []
                for x in own:  # taken[i][c]: item i is part of the best value within c of the items up to it
                    with_it = np.full(capacity + 1, -1, np.int64)
                    with_it[x["w"] :] = best[: capacity + 1 - x["w"]] + x["v"]
                    taken.append(np.packbits(with_it > best))
                    best = np.maximum(best, with_it)
                left, out = capacity, []
                for x, bits in zip(reversed(own), reversed(taken), strict=True):
                    if bits[left >> 3] >> (7 - (left & 7)) & 1:
                        out.append((x["item_id"], x["w"], x["v"]))
                        left -= x["w"]
                yield pd.DataFrame(out, columns=["item_id", "w", "v"])

    kind = items.schema["item_id"].dataType.simpleString()
    free = items.where((F.col("w") == 0) & (F.col("v") > 0)).select("item_id", F.col("w").cast("long").alias("w"), F.col("v").cast("long").alias("v"))
    return lists.mapInPandas(choose, f"item_id {kind}, w long, v long").unionByName(free)


def final_choice(heuristic: DataFrame, exact: DataFrame, capacity: int) -> DataFrame:
    """(source, value, weight, chosen): the exact choice if it fits and is strictly better than the heuristic one, else
    that one. Both are (item_id, w, v); chosen holds the item ids in order."""
    parts = [df.agg(F.lit(name).alias("source"), F.coalesce(F.sum("v"), F.lit(0)).alias("value"), F.coalesce(F.sum("w"), F.lit(0)).alias("weight"), F.array_sort(F.collect_list("item_id")).alias("chosen")) for name, df in (("heuristic", heuristic), ("exact", exact))]
    fits = F.col("weight") <= capacity
    order = F.struct((fits | (F.col("source") == "heuristic")).alias("ok"), F.when(fits, F.col("value")).otherwise(-1).alias("v"), (F.col("source") == "heuristic").alias("h"))
    return parts[0].unionByName(parts[1]).agg(F.max_by(F.struct("source", "value", "weight", "chosen"), order).alias("x")).select("x.*")


def bound(items: DataFrame, capacity: int) -> DataFrame:
    """(bound): the value if the first item by density that does not fit were taken in part; weightless items count in
    full. Items are summed up by density, and as each sum weighs something, no more of them than the capacity matter."""
    rows = items.where(F.col("w") > 0).withColumn("density", density(F.col("v"), F.col("w"))).groupBy("density").agg(F.sum("w").alias("w"), F.sum("v").alias("v"))
    rows = rows.orderBy(F.desc("density")).limit(capacity + 1)
    before = F.coalesce(F.sum("w").over(Window.orderBy(F.desc("density")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("before", before).where(F.col("before") < capacity)
    part = F.when(F.col("before") + F.col("w") <= capacity, F.col("v").cast("double")).otherwise((capacity - F.col("before")) * F.col("density"))
    free = items.where("w = 0").select(F.col("v").cast("double").alias("x"))
    return rows.select(part.alias("x")).union(free).agg(F.round(F.sum("x"), 6).alias("bound"))


def greedy(items: DataFrame, capacity: int) -> DataFrame:
    """(item_id, w, v) taken in order of density, each if it still fits. Of one weight only the densest that fit
    together can be taken, so the fold runs over a bounded list."""
    kept = useful(items.where("w > 0"), capacity).withColumn("density", density(F.col("v"), F.col("w")))
    lists = kept.agg(F.array_sort(F.collect_list(F.struct((-F.col("density")).alias("d"), "item_id", "w", "v"))).alias("items"))
    return lists.select(F.explode(greedy_take(F.col("items"), capacity)).alias("x")).select("x.item_id", "x.w", "x.v")


def repair(chosen: DataFrame, capacity: int) -> DataFrame:
    """Chosen items (solution, item_id, w, v) without the least dense ones, dropped until the rest fits."""
    w = Window.partitionBy("solution").orderBy("density", "item_id")
    rows = chosen.withColumn("density", density(F.col("v"), F.col("w")))
    over = F.sum("w").over(Window.partitionBy("solution")) - capacity
    gone = F.coalesce(F.sum("w").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_drop", gone < over).where(~F.col("_drop")).drop("_drop", "density")


def fitness(solutions: DataFrame, capacity: int) -> DataFrame:
    """(solution, weight, value, chosen, fitness) of (solution, w, v, x): overweight costs a million a unit."""
    on = F.col("x") == 1
    sums = solutions.groupBy("solution").agg(*(F.sum(F.when(on, F.col(c)).otherwise(0)).alias(n) for c, n in (("w", "weight"), ("v", "value"))), F.count_if(on).alias("chosen"))
    return sums.withColumn("fitness", (F.col("value") - 1e6 * F.greatest(F.lit(0), F.col("weight") - capacity)).cast("double"))


def swap(solution: DataFrame, capacity: int) -> DataFrame:
    """(solution, out_item, in_item): the least dense chosen and the densest other item, where exchanging them fits
    and does not lower the value."""
    rows = solution.withColumn("density", density(F.col("v"), F.col("w")))
    least = F.min_by(F.struct("item_id", "w", "v"), F.when(F.col("x") == 1, F.struct("density", "item_id"))).alias("a")
    most = F.max_by(F.struct("item_id", "w", "v"), F.when(F.col("x") == 0, F.struct("density", (-F.col("item_id")).alias("i")))).alias("b")
    both = rows.groupBy("solution").agg(least, most, F.sum(F.when(F.col("x") == 1, F.col("w")).otherwise(0)).alias("weight"))
    fits = (F.col("weight") > capacity) & (F.col("weight") - F.col("a.w") + F.col("b.w") <= capacity) & (F.col("b.v") >= F.col("a.v"))
    return both.where(fits).select("solution", F.col("a.item_id").alias("out_item"), F.col("b.item_id").alias("in_item"))


def selection(solutions: DataFrame, temperature: float, amplify: float = 1.6, suppress: float = 0.5, elite: int = 5) -> DataFrame:
    """(group_id, solution, p): softmax over fitness; the best is amplified, near but unequal ones of the next few are
    suppressed, and the sum is 1 again. solutions: (group_id, solution, fitness)."""
    w = Window.partitionBy("group_id")
    order = w.orderBy(F.desc("fitness"), "solution")
    rows = solutions.withColumn("best", F.max("fitness").over(w)).withColumn("r", F.row_number().over(order))
    raw = F.exp((F.col("fitness") - F.col("best")) / max(1e-6, temperature))
    near = (F.col("r") <= elite) & (F.col("fitness") >= F.col("best") * 0.99) & (F.abs(F.col("fitness") - F.col("best")) > 1e-9 * F.greatest(F.lit(1.0), F.abs("best")))
    rows = rows.withColumn("q", raw * F.when(F.col("r") == 1, amplify).when(near, suppress).otherwise(1.0))
    total = F.sum("q").over(w)
    return rows.select("group_id", "solution", F.round(F.when(total > 0, F.col("q") / total).otherwise(1 / F.count("*").over(w)), 9).alias("p"))


def roulette(df: DataFrame, draws: DataFrame) -> DataFrame:
    """(group_id, draw, solution): the first solution whose running sum of p reaches the draw's number; the last one
    if none does. draws: (group_id, draw, r)."""
    w = Window.partitionBy("group_id").orderBy("solution")
    summed = df.withColumn("upto", F.sum("p").over(w)).withColumn("last", F.max("solution").over(Window.partitionBy("group_id")))
    met = draws.join(summed, "group_id").groupBy("group_id", "draw").agg(F.min(F.when(F.col("upto") >= F.col("r"), F.col("solution"))).alias("s"), F.max("last").alias("last"))
    return met.select("group_id", "draw", F.coalesce("s", "last").alias("solution"))


def colony(items: DataFrame, capacity: int, islands: int = 4, bees: int = 600, rounds: int = 250, seed: int = 1) -> DataFrame:
    """(island, weight, value, chosen): a seeded bee colony on each island; never above the optimum. The items are
    the useful ones, whose number the capacity bounds."""
    rows = useful(items, capacity).agg(F.collect_list(F.struct("item_id", "w", "v")).alias("items"))
    each = items.sparkSession.range(islands).withColumnRenamed("id", "island").repartition(islands, "island").crossJoin(F.broadcast(rows))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for island, own in zip(b["island"], b["items"], strict=True):
                ids, w, v = (np.array([x[c] for x in own], np.int64) for c in ("item_id", "w", "v"))
                x = Colony(w, v, capacity, bees, seed * 1000 + island).run(rounds)
                yield pd.DataFrame([{"island": island, "weight": int(w[x].sum()), "value": int(v[x].sum()), "chosen": sorted(ids[x].tolist())}])

    return each.mapInPandas(search, "island long, weight long, value long, chosen array<long>")


class Colony:
    """Bees hold solutions, as rows of a matrix; all bees of a phase move together.

    A round: every employed bee moves its own solution, onlookers move solutions drawn by softmax fitness, scouts give
    up solutions that have not improved for `limit` rounds, every fifth round pairs are crossed, and the trail of the
    best fifth fades and is renewed. The limit shrinks while the best stagnates and grows back when it improves.
    """

    NOISE, SKIP, TOURNAMENT = 0.1, 0.2, 5

    def __init__(self, w: np.ndarray, v: np.ndarray, capacity: int, bees: int, seed: int):
        self.w, self.v, self.capacity, self.bees, self.n = w, v, capacity, bees, len(w)
        self.r = np.random.default_rng(seed)
        self.density = v / np.maximum(1, w)
        self.order = np.lexsort((np.arange(self.n), -self.density))
        self.trail = np.ones(self.n)
        self.limit = self.most = 20

    def filled(self, x: np.ndarray, skip: float = 0.0) -> np.ndarray:
        """Takes items by density as they fit, each skipped at the given chance."""
        left = self.capacity - x @ self.w
        for i in self.order:
            take = ~x[:, i] & (self.w[i] <= left)
            if skip:
                take &= self.r.random(len(x)) >= skip
            x[take, i] = True
            left -= take * self.w[i]
        return x

    def mended(self, x: np.ndarray) -> np.ndarray:
        """Too heavy solutions first exchange their least dense item for the densest other, where that makes them fit and
        no worse; then they drop the least dense ones until they fit, and what fits again is taken."""
        over = np.flatnonzero(x @ self.w > self.capacity)
        if len(over) and self.n:
            own, rows = x[over], np.arange(len(over))
            out = np.where(own, self.density, np.inf).argmin(1)
            new = np.where(own, -np.inf, self.density).argmax(1)
            ok = own[rows, out] & ~own[rows, new] & (own @ self.w - self.w[out] + self.w[new] <= self.capacity) & (self.v[new] >= self.v[out])
            own[rows[ok], out[ok]], own[rows[ok], new[ok]] = False, True
            excess = own @ self.w - self.capacity
            for i in self.order[::-1]:
                drop = own[:, i] & (excess > 0)
                own[drop, i] = False
                excess -= drop * self.w[i]
            x[over] = own
        return self.filled(x)

    def moved(self, x: np.ndarray) -> np.ndarray:
        """Two flips, each the winner of a tournament by trail and density; half of the bees exchange two items, and
        noise flips one more."""
        x = x.copy()
        if not self.n:
            return x
        rows, worth = np.arange(len(x)), self.trail * (self.density + 1e-9)
        for _ in range(2):
            picked = self.r.integers(self.n, size=(len(x), self.TOURNAMENT))
            gain = np.where(x[rows[:, None], picked], 1 / worth[picked], worth[picked])
            x[rows, picked[rows, gain.argmax(1)]] ^= True
        both = self.r.integers(self.n, size=(len(x), 2))
        swap = (self.r.random(len(x)) < 0.5) & (x[rows, both[:, 0]] != x[rows, both[:, 1]])
        x[rows[swap, None], both[swap]] ^= True
        noisy = self.r.random(len(x)) < self.NOISE
        x[rows[noisy], both[noisy, 0]] ^= True
        return self.mended(x)

    def _offered(self, at: np.ndarray, x: np.ndarray) -> None:
        """Solutions for the bees `at`; each takes the best one offered if it is not worse than its own."""
        value = x @ self.v
        order = np.lexsort((value, at))
        last = np.flatnonzero(np.append(at[order][1:] != at[order][:-1], True))
        at, x, value = at[order[last]], x[order[last]], value[order[last]]
        better, ok = value > self.value[at], value >= self.value[at]
        self.x[at[ok]], self.value[at[ok]] = x[ok], value[ok]
        self.age[at] = np.where(better, 0, self.age[at] + 1)

    def run(self, rounds: int) -> np.ndarray:
        every = np.arange(self.bees)
        self.x = self.filled(np.zeros((self.bees, self.n), bool), self.SKIP)
        self.value, self.age = self.x @ self.v, np.zeros(self.bees, np.int64)
        best, top, still = self.x[self.value.argmax()].copy(), int(self.value.max()), 0
        for step in range(rounds):
            heat = 0.08 + (0.03 - 0.08) * step / max(1, rounds - 1)
            self._offered(every, self.moved(self.x))
            p = np.exp((self.value - self.value.max()) / max(1.0, heat * self.value.max()))
            drawn = self.r.choice(self.bees, self.bees, p=p / p.sum())
            self._offered(drawn, self.moved(self.x[drawn]))
            if step % 5 == 4:
                a, b = self.r.permutation(self.bees), self.r.permutation(self.bees)
                self._offered(a, self.mended(np.where(self.r.random(self.x.shape) < 0.5, self.x[a], self.x[b])))
            tired = np.flatnonzero(self.age > self.limit)
            if len(tired):
                self.x[tired] = self.filled(np.zeros((len(tired), self.n), bool), self.SKIP)
                self.value[tired], self.age[tired] = self.x[tired] @ self.v, 0
            elite = np.argsort(-self.value, kind="stable")[: max(1, self.bees // 5)]
            self.trail = np.clip(0.95 * self.trail + 0.05 * self.x[elite].mean(0), 1e-3, 1) if self.n else self.trail
            if self.value.max(initial=-1) > top:
                best, top, still = self.x[self.value.argmax()].copy(), int(self.value.max()), 0
            else:
                still += 1
            self.limit = max(5, self.most - still // 5)
        return best
