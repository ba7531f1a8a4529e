"""Scaling laws as column expressions.

Coordinates of a run: n parameters in 1e8, d human tokens in 1e9, r added tokens per human token, t human tokens per
20 parameters. A law takes its coefficients by name (those called log... are logarithms) and the coordinates, and gives
the predicted loss; being expressions, laws run in generated code over any number of runs. The same laws take numpy
arrays, complex ones too, which is what fitting needs (``webloom.functions.fitting``).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Coefficients = Mapping[str, float]


def _either(on_column, on_array):
    return lambda x: on_column(x) if isinstance(x, Column) else on_array(x)


exp, log, log1p, expm1, tanh = (_either(getattr(F, f), getattr(np, f)) for f in ("exp", "log", "log1p", "expm1", "tanh"))


def power(base, exponent):
    if isinstance(base, Column) or isinstance(exponent, Column):
        return F.pow(base, exponent if isinstance(exponent, Column) else F.lit(float(exponent)))
    return base**exponent


def positive_or(x, other: float):
    """``x`` where it is above 0, else the number."""
    return F.when(x > 0, x).otherwise(F.lit(other)) if isinstance(x, Column) else np.where(np.real(x) > 0, x, other)


def smaller(a, b):
    return F.least(a, b) if isinstance(a, Column) else np.where(np.real(a) <= np.real(b), a, b)


@dataclass(frozen=True)
class Coordinates:
    n: Column
    d: Column
    r: Column
    t: Column

    @classmethod
    def of(cls, parameters: Column, human: Column, added: Column) -> Coordinates:
        return cls(parameters / 1e8, human / 1e9, added / human, human / (20 * parameters))

    @property
    def total(self) -> Column:
        return self.d * (1 + self.r)

    @property
    def share(self) -> Column:
        """Of the added tokens among all."""
        return self.r / (1 + self.r)

    @property
    def human_share(self) -> Column:
        return 1 / (1 + self.r)


def with_coordinates(df: DataFrame, parameters: str, human: str, added: str) -> DataFrame:
    """``df`` with columns n, d, r, t; a run without positive parameters and human tokens, or with negative added ones, is an error."""
    good = (F.col(parameters) > 0) & (F.col(human) > 0) & (F.col(added) >= 0)
    checked = F.when(good, F.col(human).cast("double")).otherwise(F.raise_error(F.lit("a run needs parameters, human tokens and no negative added tokens")).cast("double"))
    x = Coordinates.of(F.col(parameters).cast("double"), checked, F.col(added).cast("double"))
    return df.withColumns({"n": x.n, "d": x.d, "r": x.r, "t": x.t})


def _exp(p: Coefficients, name: str) -> float:
    return math.exp(p[name]) if isinstance(p[name], (int, float)) else np.exp(p[name])


def power_or_zero(base: Column, exponent: float) -> Column:
    if isinstance(base, Column):
        return F.when(base > 0, power(base, exponent)).otherwise(F.lit(0.0))
    return np.where(np.real(base) > 0, power(positive_or(base, 1.0), exponent), 0.0)


def _floor_and_model(p: Coefficients, x: Coordinates) -> Column:
    return _exp(p, "logE") + _exp(p, "logA") * power(x.n, -p["alpha"])


def _data(p: Coefficients, tokens: Column) -> Column:
    return _exp(p, "logB") * power(tokens, -p["beta"])


def saturating(window: Column | float, r: Column) -> Column:
    """Credit that grows as ``r`` at first and levels off at the window."""
    return -window * expm1(-r / window)


def window_of(p: Coefficients, x: Coordinates) -> Column:
    return exp(p["logK"] + p.get("rho", 0.0) * log(x.t) + p.get("sigma", 0.0) * log(x.n))


def credit_of(kind: str, p: Coefficients, x: Coordinates) -> Column:
    """Human tokens that the added ones are worth, per human token: none, linear, exp, rational or tanh."""
    if kind == "none":
        return 0.0 * x.r
    eta = _exp(p, "logeta") if "logeta" in p else 1.0
    if kind == "linear":
        return eta * x.r
    window = window_of(p, x)
    forms = {"exp": lambda: saturating(window, x.r), "rational": lambda: x.r / (1 + x.r / window), "tanh": lambda: window * tanh(x.r / window)}
    return eta * forms[kind]()


def box_cox(r: Column, exponent: float) -> Column:
    """((1 + r)^exponent - 1) / exponent, by its series near exponent 0."""
    x = log1p(r)
    if abs(exponent) >= 1e-5:
        return expm1(exponent * x) / exponent
    out, term = x, x
    for k in range(2, 6):
        term = term * x * exponent / k
        out = out + term
    return out


def harm_of(kind: str, p: Coefficients, x: Coordinates) -> Column:
    """Relative harm of the added tokens: none, logshare, log, boxcox or power."""
    if kind == "none":
        return 0.0 * x.r
    forms = {"logshare": lambda: log1p(x.r) - x.share, "log": lambda: log1p(x.r), "boxcox": lambda: box_cox(x.r, p["lam"]), "power": lambda: power_or_zero(x.r, p["power"])}
    return p["gamma"] * power(x.t, p.get("u", 0.0)) * power(x.n, p.get("v", 0.0)) * forms[kind]()


def effective_data_law(p: Coefficients, x: Coordinates, *, credit: str = "exp", harm: str = "logshare", on_data: bool = True) -> Column:
    """Loss with an effective token count (saturating credit) and a decelerating harm; the parameters give every ablation."""
    data = _data(p, x.d * (1 + credit_of(credit, p, x)))
    hurt = harm_of(harm, p, x)
    return _floor_and_model(p, x) + (data * (1 + hurt) if on_data else data + hurt)


def chinchilla(p: Coefficients, x: Coordinates) -> Column:
    return _floor_and_model(p, x) + _data(p, x.total)


def muennighoff(p: Coefficients, x: Coordinates) -> Column:
    """Repetition of unique data, with excess parameters discounted too."""
    a, b = _exp(p, "logA"), _exp(p, "logB")
    data = x.d * (1 + saturating(_exp(p, "logK"), x.r))
    optimal = (p["alpha"] * a / (p["beta"] * b)) ** (1 / p["alpha"]) * power(x.d, p["beta"] / p["alpha"])
    used = smaller(optimal, x.n)
    size = used * (1 + saturating(_exp(p, "log_rn_star"), x.n / used - 1))
    return _exp(p, "logE") + a * power(size, -p["alpha"]) + _data(p, data)


def windowed(p: Coefficients, x: Coordinates) -> Column:
    return _floor_and_model(p, x) + _data(p, x.d * (1 + saturating(window_of(p, x), x.r)))


def lovelace(p: Coefficients, x: Coordinates) -> Column:
    return chinchilla(p, x) + p["gamma"] * power_or_zero(x.r, p["power"]) * power(x.t, p["u"]) * power(x.n, p["v"])


def atlas(p: Coefficients, x: Coordinates) -> Column:
    return _floor_and_model(p, x) + _data(p, x.d * (1 + _exp(p, "log_transfer") * x.r))


def he(p: Coefficients, x: Coordinates) -> Column:
    return chinchilla(p, x) * power(x.human_share, -p["family_power"])


def hamidieh(p: Coefficients, x: Coordinates) -> Column:
    """Domain rates on the logarithms of raw token counts."""
    log_human = log(x.d) + math.log(1e9)
    log_added = log_human + log(positive_or(x.r, 1.0))
    shift = p["domain_h_rate"] * x.human_share * log_human + p["domain_ai_rate"] * x.share * log_added
    return _floor_and_model(p, x) + _exp(p, "logB") * exp(-p["beta"] * log(x.total) - shift)


def _mixture(p: Coefficients, x: Coordinates) -> Column:
    return 1 / (_exp(p, "log_mix_h") * power(x.human_share, p["mix_h_power"]) + _exp(p, "log_mix_ai") * power_or_zero(x.share, p["mix_ai_power"]))


def shukor_additive(p: Coefficients, x: Coordinates) -> Column:
    return chinchilla(p, x) + _mixture(p, x)


def shukor_joint(p: Coefficients, x: Coordinates) -> Column:
    """Amplitudes that are powers of a mix of both sources'."""
    mix = lambda kind: power(_exp(p, f"log_{kind}_h") * x.human_share + _exp(p, f"log_{kind}_ai") * x.share, p[f"{kind}_mix_power"])
    return _exp(p, "logE") + mix("model") * power(x.n, -p["alpha"]) + mix("data") * power(x.total, -p["beta"]) + _mixture(p, x)


def sedova(p: Coefficients, x: Coordinates) -> Column:
    return _floor_and_model(p, x) + power(x.n, p["size_coupling"]) * _data(p, x.d * (1 + _exp(p, "log_transfer") * x.r)) + p["share_tax"] * x.share


def jain(p: Coefficients, x: Coordinates) -> Column:
    noise = (1 + _exp(p, "log_surrogate_noise") * x.r) / power(1 + x.r, 2.0)
    return _floor_and_model(p, x) + _exp(p, "logB") * power(noise / x.d, p["beta"]) + p["mismatch"] * power(x.share, 2.0)


# The named ablations of the effective-data law: credit, harm, whether the harm is on the data term, and the coefficients that are held at a value.
ABLATIONS: dict[str, tuple[str, str, bool, dict[str, float]]] = {
    "benefit_none": ("none", "logshare", True, {}), "benefit_linear": ("linear", "logshare", True, {}), "benefit_exp_unit": ("exp", "logshare", True, {"logeta": 0.0}), "benefit_rational": ("rational", "logshare", True, {}), "benefit_tanh": ("tanh", "logshare", True, {}),
    "benefit_exp_constant": ("exp", "logshare", True, {"rho": 0.0}), "benefit_exp_size": ("exp", "logshare", True, {}), "ours": ("exp", "logshare", True, {"sigma": 0.0}), "harm_none": ("exp", "none", True, {"sigma": 0.0}),
    "harm_logshare_constant": ("exp", "logshare", True, {"sigma": 0.0, "u": 0.0, "v": 0.0}), "harm_logshare_budget": ("exp", "logshare", True, {"sigma": 0.0, "v": 0.0}), "harm_logshare_size": ("exp", "logshare", True, {"sigma": 0.0, "u": 0.0}),
    "harm_logshare_additive": ("exp", "logshare", False, {"sigma": 0.0}), "harm_log": ("exp", "log", True, {"sigma": 0.0}), "harm_boxcox": ("exp", "boxcox", True, {"sigma": 0.0}), "harm_power": ("exp", "power", False, {"sigma": 0.0}),
}


def ablation(name: str, p: Coefficients, x: Coordinates) -> Column:
    """The loss by a named ablation; all but the one with a window by size hold sigma at 0."""
    credit, harm, on_data, held = ABLATIONS[name]
    return effective_data_law({**p, **({} if name == "benefit_exp_size" else {"sigma": 0.0}), **held}, x, credit=credit, harm=harm, on_data=on_data)


LAWS: dict[str, Callable[[Coefficients, Coordinates], Column]] = {
    "effective_data": effective_data_law, "chinchilla": chinchilla, "muennighoff": muennighoff, "windowed": windowed, "lovelace": lovelace, "atlas": atlas,
    "he": he, "hamidieh": hamidieh, "shukor_additive": shukor_additive, "shukor_joint": shukor_joint, "sedova": sedova, "jain": jain,
}


def huber(residual: Column, delta: float = 0.1) -> Column:
    size = F.abs(residual)
    return F.when(size <= delta, residual * residual / 2).otherwise(delta * (size - delta / 2))
