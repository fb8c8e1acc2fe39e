"""Window columns grouped into dependency layers.

A window over a window needs a projection between them.  ``Layers`` collects named columns, each at the first layer
where its inputs exist, and emits one ``withColumns`` per layer.  All windows share one partitioning and one order, so
Spark plans a single exchange and a single sort however many columns and layers there are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapeloom.functions.numeric import as_col, div, ln
from tapeloom.operators.tiling import COARSE, COARSE_ROWS, FINE, FINE_ROWS, ROW, TILE, tile_window

SHORT_FRAME = 32
LARGEST_EXPONENT = 600.0  # exp(709) is the largest double
DECAY_DIGITS = 39.2  # exp(-39.2) is below half a unit in the last place of a double


class Node:
    """A column expression and the number of layers that must exist before it can be evaluated."""

    __slots__ = ("col", "layer")

    def __init__(self, col: Column, layer: int):
        self.col, self.layer = col, layer

    @staticmethod
    def apply(fn: Callable[..., Column], *args) -> "Node":
        layer = max((a.layer for a in args if isinstance(a, Node)), default=0)
        return Node(fn(*[a.col if isinstance(a, Node) else as_col(a) for a in args]), layer)

    def __add__(self, o): return Node.apply(lambda a, b: a + b, self, o)
    def __radd__(self, o): return Node.apply(lambda a, b: b + a, self, o)
    def __sub__(self, o): return Node.apply(lambda a, b: a - b, self, o)
    def __rsub__(self, o): return Node.apply(lambda a, b: b - a, self, o)
    def __mul__(self, o): return Node.apply(lambda a, b: a * b, self, o)
    def __rmul__(self, o): return Node.apply(lambda a, b: b * a, self, o)
    def __truediv__(self, o): return Node.apply(div, self, o)
    def __rtruediv__(self, o): return Node.apply(lambda a, b: div(b, a), self, o)
    def __neg__(self): return Node.apply(lambda a: -a, self)
    def __gt__(self, o): return Node.apply(lambda a, b: a > b, self, o)
    def __ge__(self, o): return Node.apply(lambda a, b: a >= b, self, o)
    def __lt__(self, o): return Node.apply(lambda a, b: a < b, self, o)
    def __le__(self, o): return Node.apply(lambda a, b: a <= b, self, o)
    def __and__(self, o): return Node.apply(lambda a, b: a & b, self, o)


class Layers:
    def __init__(self, df: DataFrame, keys: Sequence[str]):
        self.df, self.keys = df, list(keys)
        self.window = tile_window(keys)
        self.stages: list[dict[str, Column]] = []
        self.memo: dict[str, Node] = {}

    # -- building blocks ----------------------------------------------------------------------------------------

    def source(self, name: str) -> Node:
        return Node(F.col(name), 0)

    def let(self, name: str, make: Callable[[], Node]) -> Node:
        """Named column, computed once and reused."""
        if name not in self.memo:
            node = make()
            while len(self.stages) <= node.layer:
                self.stages.append({})
            column = "_c_" + name.replace(".", "_").replace(" ", "")
            self.stages[node.layer][column] = node.col
            self.memo[name] = Node(F.col(column), node.layer + 1)
        return self.memo[name]

    def over(self, name: str, fn: Callable[..., Column], *args, frame=None) -> Node:
        spec = self.window if frame is None else frame
        return self.let(name, lambda: Node.apply(lambda *cols: fn(*cols).over(spec), *args))

    def rows(self, n: int):
        return self.window.rowsBetween(-(n - 1), 0)

    @property
    def running(self):
        return self.window.rowsBetween(Window.unboundedPreceding, 0)

    def lag(self, name: str, x: Node, k: int) -> Node:
        return self.over(f"{name}.lag{k}", lambda c: F.lag(c, k), x)

    def diff(self, name: str, x: Node) -> Node:
        return x - self.lag(name, x, 1)

    # -- frames of n rows ---------------------------------------------------------------------------------------

    def _running(self, name: str, x: Node) -> Node:
        return self.over(f"{name}.run", lambda c: F.sum(F.coalesce(c, F.lit(0.0))), x, frame=self.running)

    def _running_count(self, name: str, x: Node, test: Callable[[Column], Column] | None = None, tag="cnt") -> Node:
        flag = (lambda c: c.isNotNull()) if test is None else test
        return self.over(f"{name}.{tag}", lambda c: F.count(F.when(flag(c), 1)), x, frame=self.running)

    def _window_of(self, name: str, run: Node, n: int) -> Node:
        """Running value minus the running value n rows earlier."""
        old = self.over(f"{name}.old{n}", lambda c: F.lag(c, n), run)
        return Node.apply(lambda a, b: a - F.coalesce(b, F.lit(0)), run, old)

    def count(self, name: str, x: Node, n: int) -> Node:
        return self._window_of(f"{name}.cnt", self._running_count(name, x), n)

    def total(self, name: str, x: Node, n: int, least: int | None = None) -> Node:
        """Sum over the last n rows, NULL with fewer than ``least`` (default n) known values."""
        least = n if least is None else least
        key = f"{name}.sum{n}.{least}"
        if n <= SHORT_FRAME:
            return self.let(key, lambda: Node.apply(
                lambda c: F.when(F.count(c).over(self.rows(n)) >= least, F.sum(c).over(self.rows(n))), x))

        def build():
            known = self.count(name, x, n)
            moving = self._window_of(f"{name}.run", self._running(name, x), n)
            nonzero = self._window_of(
                f"{name}.nz", self._running_count(name, x, lambda c: c != 0, tag="nzc"), n)
            return Node.apply(
                lambda k, s, z: F.when(k >= least, F.when(z == 0, F.lit(0.0)).otherwise(s)), known, moving, nonzero)

        return self.let(key, build)

    def mean(self, name: str, x: Node, n: int) -> Node:
        return self.let(f"{name}.mean{n}", lambda: self.total(name, x, n) * (1.0 / n) if n > SHORT_FRAME
                        else Node.apply(lambda c: F.when(
                            F.count(c).over(self.rows(n)) == n, F.avg(c).over(self.rows(n))), x))

    def _extreme(self, name: str, fn, x: Node, n: int, tag: str) -> Node:
        return self.let(f"{name}.{tag}{n}", lambda: Node.apply(
            lambda c: F.when(F.count(c).over(self.rows(n)) == n, fn(c).over(self.rows(n))), x))

    def high(self, name: str, x: Node, n: int) -> Node:
        return self._extreme(name, F.max, x, n, "max")

    def low(self, name: str, x: Node, n: int) -> Node:
        return self._extreme(name, F.min, x, n, "min")

    def _centred(self, name: str, x: Node) -> Node:
        """x minus a constant of the tile, so that sums of squares do not cancel."""
        whole = Window.partitionBy(*self.keys, TILE).orderBy(COARSE, FINE, ROW).rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing)
        anchor = self.over(f"{name}.anchor", lambda c: F.first(c, ignorenulls=True), x, frame=whole)
        return self.let(f"{name}.centred", lambda: x - anchor)

    def _constant(self, name: str, x: Node, n: int) -> Node:
        """True when the n-row frame holds one repeated value."""
        prev = self.lag(name, x, 1)
        moved = self.let(f"{name}.moved", lambda: Node.apply(
            lambda a, b: F.when(a != b, 1.0).otherwise(0.0), x, prev))
        run = self._running(f"{name}.moved", moved)
        return Node.apply(lambda d: d == 0, self._window_of(f"{name}.moves", run, n - 1))

    def moments(self, name: str, x: Node, n: int, ddof: int = 1, least: int | None = None) -> tuple[Node, Node, Node]:
        """(x minus the frame mean, standard deviation, variance) over the last n rows."""
        least = n if least is None else least
        if n <= SHORT_FRAME:
            fn = F.var_samp if ddof == 1 else F.var_pop
            var = self.let(f"{name}.var{n}.{ddof}", lambda: Node.apply(
                lambda c: F.when(F.count(c).over(self.rows(n)) >= least, fn(c).over(self.rows(n))), x))
            mean = self.let(f"{name}.avg{n}", lambda: Node.apply(
                lambda c: F.when(F.count(c).over(self.rows(n)) >= least, F.avg(c).over(self.rows(n))), x))
            return x - mean, Node.apply(F.sqrt, var), var
        xc = self._centred(name, x)
        known = self.count(name, x, n)
        s = self.total(f"{name}.c", xc, n, least)
        q = self.total(f"{name}.cc", xc * xc, n, least)
        same = self._constant(name, x, n)
        var = self.let(f"{name}.var{n}.{ddof}.{least}", lambda: Node.apply(
            lambda k, s_, q_, eq: F.when(s_.isNotNull() & (k > ddof), F.when(eq, F.lit(0.0)).otherwise(
                F.greatest((q_ - s_ * s_ / k) / (k - ddof), F.lit(0.0)))), known, s, q, same))
        return xc - s / known, Node.apply(F.sqrt, var), var

    def zscore(self, name: str, x: Node, n: int, least: int | None = None) -> Node:
        dev, sd, _ = self.moments(name, x, n, 1, least)
        return dev / sd

    def comoment(self, name: str, x: Node, y: Node, n: int) -> tuple[Node, Node, Node]:
        """(covariance, variance of x, variance of y) over the n rows, all sample, pairs complete."""
        both = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), a)
        px, py = Node.apply(both, x, y), Node.apply(both, y, x)
        sx, sy = self.total(f"{name}.px", px, n), self.total(f"{name}.py", py, n)
        sxy = self.total(f"{name}.pxy", px * py, n)
        sxx, syy = self.total(f"{name}.pxx", px * px, n), self.total(f"{name}.pyy", py * py, n)
        cov = (sxy - sx * sy * (1.0 / n)) * (1.0 / (n - 1))
        vx = (sxx - sx * sx * (1.0 / n)) * (1.0 / (n - 1))
        vy = (syy - sy * sy * (1.0 / n)) * (1.0 / (n - 1))
        return cov, vx, vy

    def running_total(self, name: str, x: Node) -> Node:
        """Cumulative sum inside the tile (for shift-invariant uses such as z-scores), NULL where x is NULL."""
        run = self._running(name, x)
        return self.let(f"{name}.cum", lambda: Node.apply(lambda a, b: F.when(b.isNotNull(), a), run, x))

    # -- exponential recursions ---------------------------------------------------------------------------------

    def ema(self, name: str, x: Node, alpha: float, least: int, gaps: bool = False) -> Node:
        """y = (1 - alpha) y_prev + alpha x, seeded with the first known x, NULL before ``least`` known values.

        Inside a block the recursion is one running sum of x scaled by (1 - alpha)^-position; the block before is
        added through its last value.  Everything older weighs less than half a unit in the last place, so the result
        is the sequential one to double precision.  With ``gaps`` missing values inside the series are allowed: the
        last level is kept and its weight decays with the rows elapsed.
        """
        keep = 1.0 - alpha
        rate = -math.log(keep)
        reach = math.ceil(DECAY_DIGITS / rate)
        # scaled values stay below exp(LARGEST_EXPONENT): fast recursions take shorter blocks
        size = FINE_ROWS
        while rate * size > LARGEST_EXPONENT:
            size //= 2
        if size < FINE_ROWS:
            block, per_block = [TILE, COARSE, FINE, F.floor(F.col(ROW) / size)], size
        elif reach <= FINE_ROWS:
            block, per_block = [TILE, COARSE, FINE], size
        elif reach <= COARSE_ROWS:
            block, per_block = [TILE, COARSE], COARSE_ROWS
        else:
            block, per_block = [TILE], None
        named = [c for c in block if isinstance(c, str)]
        order = [c for c in (COARSE, FINE, ROW) if c not in named]
        inside = Window.partitionBy(*self.keys, *block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        tag = f"{name}.ema{alpha:.9f}"
        known = self._running_count(name, x)
        row = self.source(ROW)
        if not gaps:
            base = F.first(ROW).over(inside) if per_block is None else F.floor(F.col(ROW) / per_block) * per_block
            pos = self.let(f"pos.{per_block}", lambda: Node(F.col(ROW) - base, 0))
            # the first known value carries weight 1, every later one carries alpha
            scaled = Node.apply(lambda c, k, p: F.coalesce(
                F.when(k == 1, c).otherwise(c * alpha) * F.exp(p * rate), F.lit(0.0)), x, known, pos)
            run = self.over(f"{tag}.run", F.sum, scaled, frame=inside)
            local = self.let(f"{tag}.local", lambda: Node.apply(lambda s, p: s * F.exp(-p * rate), run, pos))
            age = Node.apply(lambda p: F.exp(-(p + 1) * rate), pos)
        else:
            seen = self.over(f"{name}.lastrow", lambda c, r: F.max(F.when(c.isNotNull(), r)), x, row,
                             frame=self.window.rowsBetween(Window.unboundedPreceding, -1))
            held = Node.apply(lambda r, s: F.exp(-(r - s) * rate), row, seen)
            step = Node.apply(lambda c, h: F.when(c.isNull() | h.isNull(), F.lit(0.0)).otherwise(
                F.log(h / (h + alpha))), x, held)
            gain = Node.apply(lambda c, h: F.when(c.isNull(), F.lit(0.0)).when(h.isNull(), c).otherwise(
                alpha * c / (h + alpha)), x, held)
            decay = self.over(f"{tag}.decay", F.sum, step, frame=inside)
            run = self.over(f"{tag}.run", F.sum, Node.apply(lambda g, d: g * F.exp(-d), gain, decay), frame=inside)
            local = self.let(f"{tag}.local", lambda: Node.apply(lambda s, d: s * F.exp(d), run, decay))
            age = Node.apply(F.exp, decay)
        if per_block is not None:
            last = Node.apply(lambda r, v: F.when(r % per_block == per_block - 1, v), row, local)
            carried = self.over(f"{tag}.carry", lambda c: F.last(c, ignorenulls=True), last,
                                frame=self.window.rowsBetween(Window.unboundedPreceding, -1))
            value = Node.apply(lambda v, a, b: v + a * F.coalesce(b, F.lit(0.0)), local, age, carried)
        else:
            value = local
        return self.let(f"{tag}.{least}", lambda: Node.apply(
            lambda v, k: F.when(k >= least, v), value, known))

    # -- output -------------------------------------------------------------------------------------------------

    def build(self, outputs: dict[str, Node]) -> DataFrame:
        df = self.df
        for stage in self.stages:
            if stage:
                df = df.withColumns(stage)
        return df.withColumns({k: v.col for k, v in outputs.items()}).drop(
            *[c for stage in self.stages for c in stage])


def ema_reach(alpha: float) -> int:
    """Rows after which a value no longer moves an exponential mean in double precision."""
    return math.ceil(DECAY_DIGITS / -math.log(1.0 - alpha))


__all__ = ["Layers", "Node", "ema_reach", "div", "ln"]
