"""The formulaic factors by number, in the notation of :mod:`barloom.plans.expr`.

``sum prod std tmin tmax targmin targmax trank decay corr cov delay delta`` run along a
code's dates, ``rank scale indn`` across a date; ``advN`` is the N-day mean of amount,
``b2f`` a comparison as 0 or 1, ``spow`` a signed power.  Those with ``indn`` need ``ind``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from barloom.plans.expr import evaluate, parse, windows_of
from barloom.session import durable

# The published formulas with their whole-number windows.
FORMULAS: dict[int, str] = {
    1: "rank(targmax(spow(if(returns<0, std(returns, 20), close), 2), 5))-0.5",
    2: "-corr(rank(delta(ln(volume), 2)), rank((close-open)/open), 6)",
    3: "-corr(rank(open), rank(volume), 10)",
    4: "-trank(rank(low), 9)",
    5: "rank(open-sum(vwap, 10)/10)*(-abs(rank(close-vwap)))",
    6: "-corr(open, volume, 10)",
    7: "if(adv20<volume, -trank(abs(delta(close, 7)), 60)*sgn(delta(close, 7)), -1)",
    8: "-rank(sum(open, 5)*sum(returns, 5)-delay(sum(open, 5)*sum(returns, 5), 10))",
    9: "if(0<tmin(delta(close, 1), 5), delta(close, 1), if(tmax(delta(close, 1), 5)<0, delta(close, 1), -delta(close, 1)))",
    10: "rank(if(0<tmin(delta(close, 1), 4), delta(close, 1), if(tmax(delta(close, 1), 4)<0, delta(close, 1), -delta(close, 1))))",
    11: "(rank(tmax(vwap-close, 3))+rank(tmin(vwap-close, 3)))*rank(delta(volume, 3))",
    12: "sgn(delta(volume, 1))*(-delta(close, 1))",
    13: "-rank(cov(rank(close), rank(volume), 5))",
    14: "-rank(delta(returns, 3))*corr(open, volume, 10)",
    15: "-sum(rank(corr(rank(high), rank(volume), 3)), 3)",
    16: "-rank(cov(rank(high), rank(volume), 5))",
    17: "-rank(trank(close, 10))*rank(delta(delta(close, 1), 1))*rank(trank(volume/adv20, 5))",
    18: "-rank(std(abs(close-open), 5)+(close-open)+corr(close, open, 10))",
    19: "-sgn(close-delay(close, 7)+delta(close, 7))*(1+rank(1+sum(returns, 250)))",
    20: "-rank(open-delay(high, 1))*rank(open-delay(close, 1))*rank(open-delay(low, 1))",
    21: "if(sum(close, 8)/8+std(close, 8)<sum(close, 2)/2, -1, if(sum(close, 2)/2<sum(close, 8)/8-std(close, 8), 1, if(1<volume/adv20 or volume/adv20==1, 1, -1)))",
    22: "-delta(corr(high, volume, 5), 5)*rank(std(close, 20))",
    23: "if(sum(high, 20)/20<high, -delta(high, 2), 0)",
    24: "if(delta(sum(close, 100)/100, 100)/delay(close, 100)<0.05 or delta(sum(close, 100)/100, 100)/delay(close, 100)==0.05, -(close-tmin(close, 100)), -delta(close, 3))",
    25: "rank(-returns*adv20*vwap*(high-close))",
    26: "-tmax(corr(trank(volume, 5), trank(high, 5), 5), 3)",
    27: "if(0.5<rank(sum(corr(rank(volume), rank(vwap), 6), 2)/2), -1, 1)",
    28: "scale(corr(adv20, low, 5)+(high+low)/2-close)",
    29: "tmin(prod(rank(rank(scale(ln(sum(tmin(rank(rank(-rank(delta(close-1, 5)))), 2), 1))))), 1), 5)+trank(delay(-returns, 6), 5)",
    30: "(1-rank(sgn(close-delay(close, 1))+sgn(delay(close, 1)-delay(close, 2))+sgn(delay(close, 2)-delay(close, 3))))*sum(volume, 5)/sum(volume, 20)",
    31: "rank(rank(rank(decay(-rank(rank(delta(close, 10))), 10))))+rank(-delta(close, 3))+sgn(scale(corr(adv20, low, 12)))",
    32: "scale(sum(close, 7)/7-close)+20*scale(corr(vwap, delay(close, 5), 230))",
    33: "rank(-(1-open/close)^1)",
    34: "rank(1-rank(std(returns, 2)/std(returns, 5))+(1-rank(delta(close, 1))))",
    35: "trank(volume, 32)*(1-trank(close+high-low, 16))*(1-trank(returns, 32))",
    36: "2.21*rank(corr(close-open, delay(volume, 1), 15))+0.7*rank(open-close)+0.73*rank(trank(delay(-returns, 6), 5))+rank(abs(corr(vwap, adv20, 6)))+0.6*rank((sum(close, 200)/200-open)*(close-open))",
    37: "rank(corr(delay(open-close, 1), close, 200))+rank(open-close)",
    38: "-rank(trank(close, 10))*rank(close/open)",
    39: "-rank(delta(close, 7)*(1-rank(decay(volume/adv20, 9))))*(1+rank(sum(returns, 250)))",
    40: "-rank(std(high, 10))*corr(high, volume, 10)",
    41: "(high*low)^0.5-vwap",
    42: "rank(vwap-close)/rank(vwap+close)",
    43: "trank(volume/adv20, 20)*trank(-delta(close, 7), 8)",
    44: "-corr(high, rank(volume), 5)",
    45: "-rank(sum(delay(close, 5), 20)/20)*corr(close, volume, 2)*rank(corr(sum(close, 5), sum(close, 20), 2))",
    46: "if(0.25<(delay(close, 20)-delay(close, 10))/10-(delay(close, 10)-close)/10, -1, if((delay(close, 20)-delay(close, 10))/10-(delay(close, 10)-close)/10<0, 1, -(close-delay(close, 1))))",
    47: "rank(1/close)*volume/adv20*(high*rank(high-close)/(sum(high, 5)/5))-rank(vwap-delay(vwap, 5))",
    48: "indn(corr(delta(close, 1), delta(delay(close, 1), 1), 250)*delta(close, 1)/close)/sum((delta(close, 1)/delay(close, 1))^2, 250)",
    49: "if((delay(close, 20)-delay(close, 10))/10-(delay(close, 10)-close)/10<-0.1, 1, -(close-delay(close, 1)))",
    50: "-tmax(rank(corr(rank(volume), rank(vwap), 5)), 5)",
    51: "if((delay(close, 20)-delay(close, 10))/10-(delay(close, 10)-close)/10<-0.05, 1, -(close-delay(close, 1)))",
    52: "(-tmin(low, 5)+delay(tmin(low, 5), 5))*rank((sum(returns, 240)-sum(returns, 20))/220)*trank(volume, 5)",
    53: "-delta((close-low-(high-close))/(close-low), 9)",
    54: "-(low-close)*open^5/((low-high)*close^5)",
    55: "-corr(rank((close-tmin(low, 12))/(tmax(high, 12)-tmin(low, 12))), rank(volume), 6)",
    57: "0-1*((close-vwap)/decay(rank(targmax(close, 30)), 2))",
    58: "-trank(decay(corr(indn(vwap), volume, 3), 7), 5)",
    59: "-trank(decay(corr(indn(vwap*0.728317+vwap*(1-0.728317)), volume, 4), 16), 8)",
    60: "0-1*(2*scale(rank((close-low-(high-close))/(high-low)*volume))-scale(rank(targmax(close, 10))))",
    61: "b2f(rank(vwap-tmin(vwap, 16))<rank(corr(vwap, adv180, 17)))",
    62: "b2f(rank(corr(vwap, sum(adv20, 22), 9))<rank(b2f(rank(open)+rank(open)<rank((high+low)/2)+rank(high))))*(-1)",
    63: "(rank(decay(delta(indn(close), 2), 8))-rank(decay(corr(vwap*0.318108+open*(1-0.318108), sum(adv180, 37), 13), 12)))*(-1)",
    64: "b2f(rank(corr(sum(open*0.178404+low*(1-0.178404), 12), sum(adv120, 12), 16))<rank(delta((high+low)/2*0.178404+vwap*(1-0.178404), 3)))*(-1)",
    65: "b2f(rank(corr(open*0.00817205+vwap*(1-0.00817205), sum(adv60, 8), 6))<rank(open-tmin(open, 13)))*(-1)",
    66: "(rank(decay(delta(vwap, 3), 7))+trank(decay((low*0.96633+low*(1-0.96633)-vwap)/(open-(high+low)/2), 11), 6))*(-1)",
    67: "rank(high-tmin(high, 2))^rank(corr(indn(vwap), indn(adv20), 6))*(-1)",
    68: "b2f(trank(corr(rank(high), rank(adv15), 8), 13)<rank(delta(close*0.518371+low*(1-0.518371), 1)))*(-1)",
    69: "rank(tmax(delta(indn(vwap), 2), 4))^trank(corr(close*0.490655+vwap*(1-0.490655), adv20, 4), 9)*(-1)",
    70: "rank(delta(vwap, 1))^trank(corr(indn(close), adv50, 17), 17)*(-1)",
    71: "max2(trank(decay(corr(trank(close, 3), trank(adv180, 12), 18), 4), 15), trank(decay(rank(low+open-(vwap+vwap))^2, 16), 4))",
    72: "rank(decay(corr((high+low)/2, adv40, 8), 10))/rank(decay(corr(trank(vwap, 3), trank(volume, 18), 6), 2))",
    73: "max2(rank(decay(delta(vwap, 4), 2)), trank(decay(delta(open*0.147155+low*(1-0.147155), 2)/(open*0.147155+low*(1-0.147155))*(-1), 3), 16))*(-1)",
    74: "b2f(rank(corr(close, sum(adv30, 37), 15))<rank(corr(rank(high*0.0261661+vwap*(1-0.0261661)), rank(volume), 11)))*(-1)",
    75: "b2f(rank(corr(vwap, volume, 4))<rank(corr(rank(low), rank(adv50), 12)))",
    76: "max2(rank(decay(delta(vwap, 1), 11)), trank(decay(trank(corr(indn(low), adv81, 8), 19), 17), 19))*(-1)",
    77: "min2(rank(decay((high+low)/2+high-(vwap+high), 20)), rank(decay(corr((high+low)/2, adv40, 3), 5)))",
    78: "rank(corr(sum(low*0.352233+vwap*(1-0.352233), 19), sum(adv40, 19), 6))^rank(corr(rank(vwap), rank(volume), 5))",
    79: "b2f(rank(delta(indn(close*0.60733+open*(1-0.60733)), 1))<rank(corr(trank(vwap, 3), trank(adv150, 9), 14)))",
    80: "rank(sgn(delta(indn(open*0.868128+high*(1-0.868128)), 4)))^trank(corr(high, adv10, 5), 5)*(-1)",
    81: "b2f(rank(ln(prod(rank(rank(corr(vwap, sum(adv10, 49), 8))^4), 14)))<rank(corr(rank(vwap), rank(volume), 5)))*(-1)",
    82: "min2(rank(decay(delta(open, 1), 14)), trank(decay(corr(indn(volume), open, 17), 6), 13))*(-1)",
    83: "rank(delay((high-low)/(sum(close, 5)/5), 2))*rank(rank(volume))/((high-low)/(sum(close, 5)/5)/(vwap-close))",
    84: "spow(trank(vwap-tmax(vwap, 15), 20), delta(close, 4))",
    85: "rank(corr(high*0.876703+close*(1-0.876703), adv30, 9))^rank(corr(trank((high+low)/2, 3), trank(volume, 10), 7))",
    86: "b2f(trank(corr(close, sum(adv20, 14), 6), 20)<rank(open+close-(vwap+open)))*(-1)",
    87: "max2(rank(decay(delta(close*0.369701+vwap*(1-0.369701), 1), 2)), trank(decay(abs(corr(indn(adv81), close, 13)), 4), 14))*(-1)",
    88: "min2(rank(decay(rank(open)+rank(low)-(rank(high)+rank(close)), 8)), trank(decay(corr(trank(close, 8), trank(adv60, 20), 8), 6), 2))",
    89: "trank(decay(corr(low, adv10, 6), 5), 3)-trank(decay(delta(indn(vwap), 3), 10), 15)",
    90: "rank(close-tmax(close, 4))^trank(corr(indn(adv40), low, 5), 3)*(-1)",
    91: "(trank(decay(decay(corr(indn(close), volume, 9), 16), 3), 4)-rank(decay(corr(vwap, adv30, 4), 2)))*(-1)",
    92: "min2(trank(decay(b2f((high+low)/2+close<low+open), 14), 18), trank(decay(corr(rank(low), rank(adv30), 7), 6), 6))",
    93: "trank(decay(corr(indn(vwap), adv81, 17), 19), 7)/rank(decay(delta(close*0.524434+vwap*(1-0.524434), 2), 16))",
    94: "rank(vwap-tmin(vwap, 11))^trank(corr(trank(vwap, 19), trank(adv60, 4), 18), 2)*(-1)",
    95: "b2f(rank(open-tmin(open, 12))<trank(rank(corr(sum((high+low)/2, 19), sum(adv40, 19), 12))^5, 11))",
    96: "max2(trank(decay(corr(rank(vwap), rank(volume), 3), 4), 8), trank(decay(targmax(corr(trank(close, 7), trank(adv60, 4), 3), 12), 14), 13))*(-1)",
    97: "(rank(decay(delta(indn(low*0.721001+vwap*(1-0.721001)), 3), 20))-trank(decay(trank(corr(trank(low, 7), trank(adv60, 17), 4), 18), 15), 6))*(-1)",
    98: "rank(decay(corr(vwap, sum(adv5, 26), 4), 7))-rank(decay(trank(targmin(corr(rank(open), rank(adv15), 20), 8), 6), 8))",
    99: "b2f(rank(corr(sum((high+low)/2, 19), sum(adv60, 19), 8))<rank(corr(low, volume, 6)))*(-1)",
    100: "0-1*((1.5*scale(indn(indn(rank((close-low-(high-close))/(high-low)*volume))))-scale(indn(corr(close, rank(adv20), 5)-rank(targmin(close, 30)))))*(volume/adv20))",
    101: "(close-open)/(high-low+0.001)",
}

SETTLED_FROM = 20
#: Factors that compare within an industry.
NEEDS_INDUSTRY = tuple(n for n, f in FORMULAS.items() if "indn(" in f)


def look_back(number: int) -> int:
    """Rows of history before the first value (an upper bound)."""
    return windows_of(parse(FORMULAS[number]))


def alpha(panel: DataFrame, number: int) -> DataFrame:
    """(code, date, value) of one factor."""
    return evaluate(panel, {"value": FORMULAS[number]}, ["code", "date"])


def compute_all(panel: DataFrame, numbers: list[int] | None = None) -> DataFrame:
    """``code, date`` and one column ``alpha_N`` for each factor that the panel's columns allow.

    Sub-formulas that factors share are computed once, and all factors together change
    layout no more often than the one that changes it most (five times).  With more than
    ``SETTLED_FROM`` factors the panel is written at each change, which keeps plans short.
    """
    able = [n for n in numbers or FORMULAS if "ind" in panel.columns or n not in NEEDS_INDUSTRY]
    settle = (lambda df: durable(df, "factors")) if len(able) > SETTLED_FROM else None
    return evaluate(panel, {f"alpha_{n}": FORMULAS[n] for n in able}, ["code", "date"], settle)
