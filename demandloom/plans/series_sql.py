"""SQL text of the forecast methods, for the second engine. ``h`` is always the name of a list."""

from ..config import BASELINE_MODELS


def let(value: str, name: str, body: str) -> str:
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def asum(a):
    return f"coalesce(list_sum({a}), 0)"


def amean(a):
    return f"(list_sum({a}) / len({a}))"


def wma(a):
    return (f"(CASE WHEN len({a}) >= 3 THEN {a}[-1] * 0.6::DOUBLE + {a}[-2] * 0.3::DOUBLE + {a}[-3] * 0.1::DOUBLE "
            f"WHEN len({a}) = 2 THEN {a}[-1] * 0.65::DOUBLE + {a}[-2] * 0.35::DOUBLE ELSE {a}[-1] END)")


def mean6(h):
    return let(f"{h}[-6:]", "r", amean("r"))


def damped(h):
    lvl = "(x * 0.45::DOUBLE + (a.l + a.t * 0.8::DOUBLE) * 0.55::DOUBLE)"
    run = let(f"list_reduce(r[2:], lambda a, x: {{'l': {lvl}, 't': ({lvl} - a.l) * 0.2::DOUBLE + a.t * 0.64::DOUBLE}}, "
              f"{{'l': r[1], 't': r[2] - r[1]}})", "z", "greatest(0.0::DOUBLE, z.l + z.t * 0.8::DOUBLE)")
    return let(f"{h}[-8:]", "r", f"CASE WHEN len(r) <= 2 THEN {wma('r')} ELSE {run} END")


def loglinear(h):
    xm = "((len(y) - 1) / 2.0::DOUBLE)"
    fit = let("list_transform(r, lambda v: ln(1 + v))", "y", let(
        f"list_sum(list_transform(y, lambda v, i: v * (i - 1 - {xm}))) / list_sum(list_transform(y, lambda v, i: (i - 1 - {xm}) * (i - 1 - {xm})))",
        "b", f"greatest(0.0::DOUBLE, exp(b * len(y) + (list_sum(y) / len(y) - b * {xm})) - 1)"))
    return let(f"{h}[-6:]", "r", f"CASE WHEN len(r) < 3 THEN {wma('r')} ELSE {fit} END")


def croston(h):
    run = let(f"list_reduce({h}[2:], lambda a, x: CASE WHEN x > 0 THEN {{'d': x * 0.2::DOUBLE + a.d * 0.8::DOUBLE, 'i': a.g * 0.2::DOUBLE + a.i * 0.8::DOUBLE, 'g': 1.0::DOUBLE}} "
              f"ELSE {{'d': a.d, 'i': a.i, 'g': a.g + 1.0::DOUBLE}} END, {{'d': p[1], 'i': 1.0::DOUBLE, 'g': 1.0::DOUBLE}})", "z",
              "CASE WHEN z.i <= 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, z.d / z.i * 0.9::DOUBLE) END")
    return let(f"list_filter({h}, lambda q: q > 0)", "p", f"CASE WHEN len(p) < 2 THEN {wma(h)} ELSE {run} END")


NEXT = {
    "naive_last": lambda h: f"{h}[-1]",
    "mean": mean6,
    "weighted_moving_average": wma,
    "trailing_12_mean": lambda h: let(f"{h}[-12:]", "r", amean("r")),
    "trend_adjusted_moving_average": lambda h: let(f"{h}[-6:]", "r", (
        f"CASE WHEN len(r) <= 2 THEN {wma('r')} ELSE greatest(0.0::DOUBLE, {wma('r')} + (r[-1] - r[1]) / (len(r) - 1)) END")),
    "damped_trend": damped,
    "log_linear_trend": loglinear,
    "seasonal_naive": lambda h: f"(CASE WHEN len({h}) >= 12 THEN {h}[-12] ELSE {mean6(h)} END)",
    "seasonal_mean": lambda h: (f"(CASE WHEN len({h}) >= 12 THEN " + let(
        f"list_filter({h}, lambda v, i: (len({h}) - i + 1) % 12 = 0)", "r", amean("r")) + f" ELSE {mean6(h)} END)"),
    "croston_sba": croston,
}


def recursive(h, model, horizon):
    nxt = lambda a: f"greatest({NEXT[model](a)}, 0.0::DOUBLE)"
    if horizon == 1:
        return f"[{nxt(h)}]"
    return f"list_reduce(range(1, {horizon + 1}), lambda acc, k: list_append(acc, {nxt('acc')}), {h})[-{horizon}:]"


def ets(h, horizon):
    lvl = "((x - a.s[1]) * 0.35::DOUBLE + (a.l + a.t) * 0.65::DOUBLE)"
    step = (f"{{'l': {lvl}, 't': ({lvl} - a.l) * 0.1::DOUBLE + a.t * 0.9::DOUBLE, "
            f"'s': list_append(a.s[2:12], (x - {lvl}) * 0.25::DOUBLE + a.s[1] * 0.75::DOUBLE)}}")
    m1, m2 = f"(list_sum({h}[1:12]) / 12)", f"(list_sum({h}[13:24]) / 12)"
    run = let(f"list_reduce({h}, lambda a, x: {step}, {{'l': {m1}, 't': ({m2} - {m1}) / 12, 's': list_transform({h}[1:12], lambda q: q - {m1})}})",
              "z", f"list_transform(range(1, {horizon + 1}), lambda k: greatest(0.0::DOUBLE, z.l + z.t * k + z.s[((k - 1) % 12) + 1]))")
    return f"(CASE WHEN len({h}) < 24 THEN {recursive(h, 'damped_trend', horizon)} ELSE {run} END)"


def path(h, model, horizon):
    return ets(h, horizon) if model == "ets_additive" else recursive(h, model, horizon)


def path_by_name(h, name, horizon):
    return "(CASE " + " ".join(f"WHEN {name} = '{m}' THEN {path(h, m, horizon)}" for m, _, _ in BASELINE_MODELS) + " END)"


def median(a):
    return f"list_median({a})"


def soften(h):
    sp = "greatest(3 * md, 0.7::DOUBLE * b, 1.0::DOUBLE)"
    y = ("CASE WHEN x < greatest(0.0::DOUBLE, b - sp) THEN greatest(0.0::DOUBLE, b - sp) + (x - greatest(0.0::DOUBLE, b - sp)) * 0.4::DOUBLE "
         "WHEN x > b + sp THEN b + sp + (x - (b + sp)) * 0.4::DOUBLE ELSE x END")
    inner = let("s.v[-6:]", "t", let("list_median(t)", "b", let("list_median(list_transform(t, lambda q: abs(q - b)))", "md", let(
        sp, "sp", f"{{'v': list_append(s.v, greatest(0.0::DOUBLE, {y})), 'n': s.n + CASE WHEN x < greatest(0.0::DOUBLE, b - sp) OR x > b + sp THEN 1 ELSE 0 END}}"))))
    return (f"list_reduce({h}, lambda s, x: CASE WHEN len(s.v) < 3 THEN {{'v': list_append(s.v, x), 'n': s.n}} ELSE {inner} END, "
            f"{{'v': []::DOUBLE[], 'n': 0}})")


ZS = "(len(list_filter({h}, lambda q: q <= 0)) / len({h})::DOUBLE)"


def eligible(h, spec):
    ok = f"len({h}) >= {spec[1]}"
    if spec[2] == "seasonal":
        ok += f" AND {ZS.format(h=h)} < 0.45"
    if spec[2] == "intermittent":
        ok += f" AND {ZS.format(h=h)} >= 0.2"
    return f"({ok})"


def start(h):
    return f"greatest(3, len({h}) - least(6, greatest(3, len({h}) // 4)))"


def select_best(h):
    """h: list name; result struct b with fields w, m, bb, k, model, prep, mae, wape, bias, n, v."""
    none_fits = " AND ".join(f"NOT {eligible(h, s)}" for s in BASELINE_MODELS)
    rows = []
    for prep, off, train, extra in (("raw", 0, h, "true"), ("cleaned", 100, "c.v", "c.n > 0")):
        for k, spec in enumerate(BASELINE_MODELS):
            ok = eligible(h, spec)
            if spec[0] == "mean":
                ok = f"({ok} OR ({none_fits}))"
            preds = f"list_transform(range({start(h)}, len({h})), lambda i: " + let(f"{train}[:i]", "t", path("t", spec[0], 1) + "[1]") + ")"
            body = let(preds, "p", let(f"{{'a': {h}[{start(h)} + 1:], 'p': p}}", "q", let(
                "{'e': list_sum(list_transform(q.p, lambda z, i: abs(z - q.a[i]))), 't': list_sum(q.a), 's': list_sum(q.p), 'c': len(q.p)}", "g",
                "{'w': CASE WHEN g.t <> 0 THEN g.e / g.t ELSE 'inf'::DOUBLE END, 'm': g.e / g.c, 'bb': CASE WHEN g.t <> 0 THEN abs((g.s - g.t) / g.t) ELSE 'inf'::DOUBLE END, "
                f"'k': {off + k}, 'model': '{spec[0]}', 'prep': '{prep}', 'mae': g.e / g.c, 'wape': CASE WHEN g.t <> 0 THEN g.e / g.t END, 'bias': CASE WHEN g.t <> 0 THEN (g.s - g.t) / g.t END}}")))
            rows.append(f"CASE WHEN len({h}) > {start(h)} AND {extra} AND {ok} THEN {body} END")
    return let(soften(h), "c", let(f"list_min(list_filter([{', '.join(rows)}], lambda z: z IS NOT NULL))", "b",
               f"{{'model': b.model, 'prep': b.prep, 'mae': b.mae, 'wape': b.wape, 'bias': b.bias, 'adjusted': CASE WHEN b.prep = 'cleaned' THEN c.n ELSE 0 END, "
               f"'train': CASE WHEN b.prep = 'cleaned' THEN c.v ELSE {h} END}}"))
