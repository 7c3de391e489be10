"""The 191 short-horizon price-volume formulas of the public broker report, in plain text.

Fixed values. ``sma(x, n, m)`` is the recursive mean with weight m / n on the newest
value; ``bigger`` and ``smaller`` compare two values of a row; ``slope(x, n)`` is the slope on
1 to n. Formulas 75, 149, 181 and 182 need columns ``index_open`` and ``index_close`` of a
benchmark; 30 regresses on three factors, see :func:`residual_30`; 143 refers to itself
and has no value; 149 has one only where the index fell on every row of its window, which must be full; 157 is the variant with a floor of 1 below its inner sum.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from quantloom.functions.dsl import parse
from quantloom.functions.expr import Expr

#: Pieces that several formulas share, by name.
PIECES: dict[str, str] = {
    "MOVE": "bigger(abs(high - delay(high, 1)), abs(low - delay(low, 1)))",
    "RISE": "((high + low) <= (delay(high, 1) + delay(low, 1)) ? 0 : MOVE)",
    "FALL": "((high + low) >= (delay(high, 1) + delay(low, 1)) ? 0 : MOVE)",
    "K9": "((close - ts_min(low, 9)) / (ts_max(high, 9) - ts_min(low, 9)) * 100)",
    "R6": "((ts_max(high, 6) - close) / (ts_max(high, 6) - ts_min(low, 6)) * 100)",
    "GAIN": "bigger(close - delay(close, 1), 0)",
    "SHIFT": "abs(close - delay(close, 1))",
    "OBV": "(close > delay(close, 1) ? volume : (close < delay(close, 1) ? -volume : 0))",
    "DTM": "(open <= delay(open, 1) ? 0 : bigger(high - open, open - delay(open, 1)))",
    "DBM": "(open >= delay(open, 1) ? 0 : bigger(open - low, open - delay(open, 1)))",
    "TYP": "((high + low + close) / 3)",
    "TR": "bigger(bigger(high - low, abs(high - delay(close, 1))), abs(low - delay(close, 1)))",
    "HD": "(high - delay(high, 1))",
    "LD": "(delay(low, 1) - low)",
    "DMINUS": "(sum(((LD > 0) && (LD > HD)) ? LD : 0, 14) * 100 / sum(TR, 14))",
    "DPLUS": "(sum(((HD > 0) && (HD > LD)) ? HD : 0, 14) * 100 / sum(TR, 14))",
    "CLV": "(((close - low) - (high - close)) / (high - low))",
    "SWING": "(((delay(close, 20) - delay(close, 10)) / 10) - ((delay(close, 10) - close) / 10))",
    "CH1": "(close / delay(close, 1) - 1)",
    "CH19": "((close / delay(close, 19)) ^ 0.05 - 1)",
    "SA": "abs(high - delay(close, 1))",
    "SB": "abs(low - delay(close, 1))",
    "SC": "abs(high - delay(low, 1))",
    "SD": "abs(delay(close, 1) - delay(open, 1))",
    "SPAN": "(((SA > SB) && (SA > SC)) ? (SA + SB / 2 + SD / 4) : (((SB > SC) && (SB > SA)) ? (SB + SA / 2 + SD / 4) : (SC + SD / 4)))",
    "RSI12": "(sma(GAIN, 12, 1) / sma(SHIFT, 12, 1) * 100)",
}

FORMULAS: dict[int, str] = {
    1: "-1 * correlation(rank(delta(log(volume), 1)), rank((close - open) / open), 6)",
    2: "-1 * delta(CLV, 1)",
    3: "sum((close == delay(close, 1)) ? 0 : (close - ((close > delay(close, 1)) ? smaller(low, delay(close, 1)) : bigger(high, delay(close, 1)))), 6)",
    4: "where(((mean(close, 8) + stddev(close, 8)) < mean(close, 2)) ? -1 : ((mean(close, 2) < (mean(close, 8) - stddev(close, 8))) ? 1 : ((volume / adv20 >= 1) ? 1 : -1)), notna(adv20))",
    5: "-1 * ts_max(correlation(ts_rank(volume, 5), ts_rank(high, 5), 5), 3)",
    6: "-1 * rank(sign(delta(open * 0.85 + high * 0.15, 4)))",
    7: "(rank(ts_max(vwap - close, 3)) + rank(ts_min(vwap - close, 3))) * rank(delta(volume, 3))",
    8: "-1 * rank(delta((high + low) / 2 * 0.2 + vwap * 0.8, 4))",
    9: "sma(((high + low) / 2 - (delay(high, 1) + delay(low, 1)) / 2) * (high - low) / volume, 7, 2)",
    10: "rank(ts_max(((returns < 0) ? stddev(returns, 20) : close) ^ 2, 5))",
    11: "sum(CLV * volume, 6)",
    12: "rank(open - sum(vwap, 10) / 10) * (-1 * rank(abs(close - vwap)))",
    13: "sqrt(high * low) - vwap",
    14: "close - delay(close, 5)",
    15: "open / delay(close, 1) - 1",
    16: "-1 * ts_max(rank(correlation(rank(volume), rank(vwap), 5)), 5)",
    17: "rank(vwap - ts_max(vwap, 15)) ^ delta(close, 5)",
    18: "close / delay(close, 5)",
    19: "(close < delay(close, 5)) ? (close - delay(close, 5)) / delay(close, 5) : ((close == delay(close, 5)) ? 0 : (close - delay(close, 5)) / close)",
    20: "(close - delay(close, 6)) / delay(close, 6) * 100",
    21: "slope(mean(close, 6), 6)",
    22: "sma((close - mean(close, 6)) / mean(close, 6) - delay((close - mean(close, 6)) / mean(close, 6), 3), 12, 1)",
    23: "where(sma((close > delay(close, 1)) ? stddev(close, 20) : 0, 20, 1) / (sma((close > delay(close, 1)) ? stddev(close, 20) : 0, 20, 1) + sma((close > delay(close, 1)) ? 0 : stddev(close, 20), 20, 1)) * 100, notna(stddev(close, 20)))",
    24: "sma(close - delay(close, 5), 5, 1)",
    25: "rank(delta(close, 7) * (1 - rank(decay_linear(volume / adv20, 9)))) * (-1 * (1 + rank(sum(returns, 250))))",
    26: "sum(close, 7) / 7 - close + correlation(vwap, delay(close, 5), 230)",
    27: "decay_linear((close - delay(close, 3)) / delay(close, 3) * 100 + (close - delay(close, 6)) / delay(close, 6) * 100, 12)",
    28: "3 * sma(K9, 3, 1) - 2 * sma(sma(K9, 3, 1), 3, 1)",
    29: "(close - delay(close, 6)) / delay(close, 6) * volume",
    31: "(close - mean(close, 12)) / mean(close, 12) * 100",
    32: "-1 * sum(rank(correlation(rank(high), rank(volume), 3)), 3)",
    33: "(-1 * ts_min(low, 5) + delay(ts_min(low, 5), 5)) * rank((sum(returns, 240) - sum(returns, 20)) / 220) * ts_rank(volume, 5)",
    34: "mean(close, 12) / close",
    35: "-1 * smaller(rank(decay_linear(delta(open, 1), 15)), rank(decay_linear(correlation(volume, open, 17), 7)))",
    36: "rank(sum(correlation(rank(volume), rank(vwap), 6), 6))",
    37: "-1 * rank(sum(open, 5) * sum(returns, 5) - delay(sum(open, 5) * sum(returns, 5), 10))",
    38: "(mean(high, 20) < high) ? (-1 * delta(high, 2)) : 0",
    39: "-1 * (rank(decay_linear(delta(close, 2), 8)) - rank(decay_linear(correlation(vwap * 0.3 + open * 0.7, sum(mean(volume, 180), 37), 14), 12)))",
    40: "sum((close > delay(close, 1)) ? volume : 0, 26) / sum((close <= delay(close, 1)) ? volume : 0, 26) * 100",
    41: "-1 * rank(ts_max(delta(vwap, 3), 5))",
    42: "-1 * (rank(stddev(high, 10)) * correlation(high, volume, 10))",
    43: "sum(OBV, 6)",
    44: "ts_rank(decay_linear(correlation(low, mean(volume, 10), 7), 6), 4) + ts_rank(decay_linear(delta(vwap, 3), 10), 15)",
    45: "rank(delta(close * 0.6 + open * 0.4, 1)) * rank(correlation(vwap, mean(volume, 150), 15))",
    46: "(mean(close, 3) + mean(close, 6) + mean(close, 12) + mean(close, 24)) / (4 * close)",
    47: "sma(R6, 9, 1)",
    48: "-1 * (rank(sign((close - delay(close, 1)) + (delay(close, 1) - delay(close, 2)) + (delay(close, 2) - delay(close, 3)))) * sum(volume, 5) / sum(volume, 20))",
    49: "sum(FALL, 12) / (sum(FALL, 12) + sum(RISE, 12))",
    50: "sum(RISE, 12) / (sum(RISE, 12) + sum(FALL, 12)) - sum(FALL, 12) / (sum(RISE, 12) + sum(FALL, 12))",
    51: "sum(RISE, 12) / (sum(RISE, 12) + sum(FALL, 12))",
    52: "sum(bigger(0, high - delay(TYP, 1)), 26) / sum(bigger(0, delay(TYP, 1) - low), 26) * 100",
    53: "count(close > delay(close, 1), 12) / 12 * 100",
    54: "-1 * rank(stddev(abs(close - open), 20) + (close - open) + correlation(close, open, 10))",
    55: "sum(16 * (close + (close - open) / 2 - delay(open, 1)) / SPAN * bigger(SA, SB), 20)",
    56: "bool(rank(open - ts_min(open, 12)) < rank(rank(correlation(sum((high + low) / 2, 19), sum(mean(volume, 40), 19), 13)) ^ 5))",
    57: "sma(K9, 3, 1)",
    58: "count(close > delay(close, 1), 20) / 20 * 100",
    59: "sum((close > delay(close, 1)) ? (close - bigger(low, delay(close, 1))) : (close - delay(close, 1)), 20)",
    60: "sum(CLV * volume, 20)",
    61: "-1 * bigger(rank(decay_linear(delta(vwap, 1), 12)), rank(decay_linear(rank(correlation(low, mean(volume, 80), 8)), 17)))",
    62: "-1 * correlation(high, rank(volume), 5)",
    63: "sma(GAIN, 6, 1) / sma(SHIFT, 6, 1) * 100",
    64: "-1 * bigger(rank(decay_linear(correlation(rank(vwap), rank(volume), 4), 4)), rank(decay_linear(ts_max(correlation(rank(close), rank(mean(volume, 60)), 4), 13), 14)))",
    65: "mean(close, 6) / close",
    66: "(close - mean(close, 6)) / mean(close, 6) * 100",
    67: "sma(GAIN, 24, 1) / sma(SHIFT, 24, 1) * 100",
    68: "sma(((high + low) / 2 - (delay(high, 1) + delay(low, 1)) / 2) * (high - low) / volume, 15, 2)",
    69: "(sum(DTM, 20) > sum(DBM, 20)) ? (sum(DTM, 20) - sum(DBM, 20)) / sum(DTM, 20) : ((sum(DTM, 20) == sum(DBM, 20)) ? 0 : (sum(DTM, 20) - sum(DBM, 20)) / sum(DBM, 20))",
    70: "stddev(amount, 6)",
    71: "(close - mean(close, 24)) / mean(close, 24) * 100",
    72: "sma(R6, 15, 1)",
    73: "-1 * (ts_rank(decay_linear(decay_linear(correlation(close, volume, 10), 16), 4), 5) - rank(decay_linear(correlation(vwap, mean(volume, 30), 4), 3)))",
    74: "rank(correlation(sum(low * 0.35 + vwap * 0.65, 20), sum(mean(volume, 40), 20), 7)) + rank(correlation(rank(vwap), rank(volume), 6))",
    75: "count((close > open) && (index_close < index_open), 50) / count(index_close < index_open, 50)",
    76: "stddev(abs(CH1) / volume, 20) / mean(abs(CH1) / volume, 20)",
    77: "smaller(rank(decay_linear((high + low) / 2 + high - (vwap + high), 20)), rank(decay_linear(correlation((high + low) / 2, mean(volume, 40), 3), 6)))",
    78: "(TYP - mean(TYP, 12)) / (0.015 * mean(abs(close - mean(TYP, 12)), 12))",
    79: "RSI12",
    80: "(volume - delay(volume, 5)) / delay(volume, 5) * 100",
    81: "sma(volume, 21, 2)",
    82: "sma(R6, 20, 1)",
    83: "-1 * rank(covariance(rank(high), rank(volume), 5))",
    84: "sum(OBV, 20)",
    85: "ts_rank(volume / mean(volume, 20), 20) * ts_rank(-1 * delta(close, 7), 8)",
    86: "(SWING > 0.25) ? -1 : ((SWING < 0) ? 1 : where(-1 * (close - delay(close, 1)), notna(SWING)))",
    87: "-1 * (rank(decay_linear(delta(vwap, 4), 7)) + ts_rank(decay_linear((low - vwap) / (open - (high + low) / 2), 11), 7))",
    88: "(close - delay(close, 20)) / delay(close, 20) * 100",
    89: "2 * (sma(close, 13, 2) - sma(close, 27, 2) - sma(sma(close, 13, 2) - sma(close, 27, 2), 10, 2))",
    90: "-1 * rank(correlation(rank(vwap), rank(volume), 5))",
    91: "-1 * (rank(close - ts_max(close, 5)) * rank(correlation(mean(volume, 40), low, 5)))",
    92: "-1 * bigger(rank(decay_linear(delta(close * 0.35 + vwap * 0.65, 2), 3)), ts_rank(decay_linear(abs(correlation(mean(volume, 180), close, 13)), 5), 15))",
    93: "sum(DBM, 20)",
    94: "sum(OBV, 30)",
    95: "stddev(amount, 20)",
    96: "sma(sma(K9, 3, 1), 3, 1)",
    97: "stddev(volume, 10)",
    98: "(delta(sum(close, 100) / 100, 100) / delay(close, 100) <= 0.05) ? (-1 * (close - ts_min(close, 100))) : (-1 * delta(close, 3))",
    99: "-1 * rank(covariance(rank(close), rank(volume), 5))",
    100: "stddev(volume, 20)",
    101: "(rank(correlation(close, sum(mean(volume, 30), 37), 15)) < rank(correlation(rank(high * 0.1 + vwap * 0.9), rank(volume), 11))) ? -1 : 0",
    102: "sma(bigger(volume - delay(volume, 1), 0), 6, 1) / sma(abs(volume - delay(volume, 1)), 6, 1) * 100",
    103: "(20 - lowday(low, 20)) / 20 * 100",
    104: "-1 * (delta(correlation(high, volume, 5), 5) * rank(stddev(close, 20)))",
    105: "-1 * correlation(rank(open), rank(volume), 10)",
    106: "close - delay(close, 20)",
    107: "-1 * rank(open - delay(high, 1)) * rank(open - delay(close, 1)) * rank(open - delay(low, 1))",
    108: "-1 * (rank(high - ts_min(high, 2)) ^ rank(correlation(vwap, mean(volume, 120), 6)))",
    109: "sma(high - low, 10, 2) / sma(sma(high - low, 10, 2), 10, 2)",
    110: "sum(bigger(high - delay(close, 1), 0), 20) / sum(bigger(delay(close, 1) - low, 0), 20) * 100",
    111: "sma(volume * CLV, 11, 2) - sma(volume * CLV, 4, 2)",
    112: "(sum((close > delay(close, 1)) ? SHIFT : 0, 12) - sum((close < delay(close, 1)) ? SHIFT : 0, 12)) / (sum((close > delay(close, 1)) ? SHIFT : 0, 12) + sum((close < delay(close, 1)) ? SHIFT : 0, 12)) * 100",
    113: "-1 * (rank(sum(delay(close, 5), 20) / 20) * correlation(close, volume, 2) * rank(correlation(sum(close, 5), sum(close, 20), 2)))",
    114: "rank(delay((high - low) / (sum(close, 5) / 5), 2)) * rank(rank(volume)) / (((high - low) / (sum(close, 5) / 5)) / (vwap - close))",
    115: "rank(correlation(high * 0.9 + close * 0.1, mean(volume, 30), 10)) ^ rank(correlation(ts_rank((high + low) / 2, 4), ts_rank(volume, 10), 7))",
    116: "slope(close, 20)",
    117: "ts_rank(volume, 32) * (1 - ts_rank(close + high - low, 16)) * (1 - ts_rank(returns, 32))",
    118: "sum(high - open, 20) / sum(open - low, 20) * 100",
    119: "rank(decay_linear(correlation(vwap, sum(mean(volume, 5), 26), 5), 7)) - rank(decay_linear(ts_rank(ts_min(correlation(rank(open), rank(mean(volume, 15)), 21), 9), 7), 8))",
    120: "rank(vwap - close) / rank(vwap + close)",
    121: "-1 * (rank(vwap - ts_min(vwap, 12)) ^ ts_rank(correlation(ts_rank(vwap, 20), ts_rank(mean(volume, 60), 2), 18), 3))",
    122: "sma(sma(sma(log(close), 13, 2), 13, 2), 13, 2) / delay(sma(sma(sma(log(close), 13, 2), 13, 2), 13, 2), 1) - 1",
    123: "(rank(correlation(sum((high + low) / 2, 20), sum(mean(volume, 60), 20), 9)) < rank(correlation(low, volume, 6))) ? -1 : 0",
    124: "(close - vwap) / decay_linear(rank(ts_max(close, 30)), 2)",
    125: "rank(decay_linear(correlation(vwap, mean(volume, 80), 17), 20)) / rank(decay_linear(delta(close * 0.5 + vwap * 0.5, 3), 16))",
    126: "(close + high + low) / 3",
    127: "sqrt(mean((100 * (close - ts_max(close, 12)) / ts_max(close, 12)) ^ 2, 12))",
    128: "100 - 100 / (1 + sum((TYP > delay(TYP, 1)) ? TYP * volume : 0, 14) / sum((TYP < delay(TYP, 1)) ? TYP * volume : 0, 14))",
    129: "sum((close < delay(close, 1)) ? SHIFT : 0, 12)",
    130: "rank(decay_linear(correlation((high + low) / 2, mean(volume, 40), 9), 10)) / rank(decay_linear(correlation(rank(vwap), rank(volume), 7), 3))",
    131: "rank(delta(vwap, 1)) ^ ts_rank(correlation(close, mean(volume, 50), 18), 18)",
    132: "mean(amount, 20)",
    133: "(20 - highday(high, 20)) / 20 * 100 - (20 - lowday(low, 20)) / 20 * 100",
    134: "(close - delay(close, 12)) / delay(close, 12) * volume",
    135: "sma(delay(close / delay(close, 20), 1), 20, 1)",
    136: "-1 * rank(delta(returns, 3)) * correlation(open, volume, 10)",
    137: "16 * (close - delay(close, 1) + (close - open) / 2 + delay(close, 1) - delay(open, 1)) / (SPAN * bigger(SA, SB))",
    138: "-1 * (rank(decay_linear(delta(low * 0.7 + vwap * 0.3, 3), 20)) - ts_rank(decay_linear(ts_rank(correlation(ts_rank(low, 8), ts_rank(mean(volume, 60), 17), 5), 19), 16), 7))",
    139: "-1 * correlation(open, volume, 10)",
    140: "smaller(rank(decay_linear(rank(open) + rank(low) - (rank(high) + rank(close)), 8)), ts_rank(decay_linear(correlation(ts_rank(close, 8), ts_rank(mean(volume, 60), 20), 8), 7), 3))",
    141: "-1 * rank(correlation(rank(high), rank(mean(volume, 15)), 9))",
    142: "-1 * rank(ts_rank(close, 10)) * rank(delta(delta(close, 1), 1)) * rank(ts_rank(volume / mean(volume, 20), 5))",
    144: "sum((close < delay(close, 1)) ? abs(CH1) / amount : 0, 20) / count(close < delay(close, 1), 20)",
    145: "(mean(volume, 9) - mean(volume, 26)) / mean(volume, 12) * 100",
    146: "mean(CH1 - sma(CH1, 61, 2), 20) * (CH1 - sma(CH1, 61, 2)) / sma((CH1 - sma(CH1, 61, 2)) ^ 2, 61, 2)",
    147: "slope(mean(close, 12), 12)",
    148: "(rank(correlation(open, sum(mean(volume, 60), 9), 6)) < rank(open - ts_min(open, 14))) ? -1 : 0",
    149: "ts_beta(where(CH1, index_close < delay(index_close, 1)), where(index_close / delay(index_close, 1) - 1, index_close < delay(index_close, 1)), 252)",
    150: "(close + high + low) / 3 * volume",
    151: "sma(close - delay(close, 20), 20, 1)",
    152: "sma(mean(delay(sma(delay(close / delay(close, 9), 1), 9, 1), 1), 12) - mean(delay(sma(delay(close / delay(close, 9), 1), 9, 1), 1), 26), 9, 1)",
    153: "(mean(close, 3) + mean(close, 6) + mean(close, 12) + mean(close, 24)) / 4",
    154: "bool((vwap - ts_min(vwap, 16)) < correlation(vwap, mean(volume, 180), 18))",
    155: "sma(volume, 13, 2) - sma(volume, 27, 2) - sma(sma(volume, 13, 2) - sma(volume, 27, 2), 10, 2)",
    156: "-1 * bigger(rank(decay_linear(delta(vwap, 5), 3)), rank(decay_linear(delta(open * 0.15 + low * 0.85, 2) / (open * 0.15 + low * 0.85) * -1, 3)))",
    157: "ts_min(product(rank(rank(log(sum(ts_min(rank(rank(sum(bigger(rank(rank(log(sum(-1 * rank(delta(close - 1, 5)), 2)))), 1), 1))), 5), 1)))), 1), 5) + ts_rank(delay(-1 * returns, 6), 5)",
    158: "((high - sma(close, 15, 2)) - (low - sma(close, 15, 2))) / close",
    159: "((close - sum(smaller(low, delay(close, 1)), 6)) / sum(bigger(high, delay(close, 1)) - smaller(low, delay(close, 1)), 6) * 288 + (close - sum(smaller(low, delay(close, 1)), 12)) / sum(bigger(high, delay(close, 1)) - smaller(low, delay(close, 1)), 12) * 144 + (close - sum(smaller(low, delay(close, 1)), 24)) / sum(bigger(high, delay(close, 1)) - smaller(low, delay(close, 1)), 24) * 144) * 100 / 504",
    160: "sma((close <= delay(close, 1)) ? stddev(close, 20) : 0, 20, 1)",
    161: "mean(bigger(bigger(high - low, abs(delay(close, 1) - high)), abs(delay(close, 1) - low)), 12)",
    162: "(RSI12 - ts_min(RSI12, 12)) / (ts_max(RSI12, 12) - ts_min(RSI12, 12))",
    163: "rank(-1 * returns * mean(volume, 20) * vwap * (high - close))",
    164: "sma((((close > delay(close, 1)) ? 1 / (close - delay(close, 1)) : 1) - ts_min((close > delay(close, 1)) ? 1 / (close - delay(close, 1)) : 1, 12)) / (high - low) * 100, 13, 2)",
    165: "-1 * (1 / stddev(close, 48)) / cs_min(sum(close - mean(close, 48), 48)) - cs_max(sum(close - mean(close, 48), 48))",
    166: "-20 * 82.8190799272728 * sum(CH1 - mean(CH1, 20), 20) / (342 * sum(CH1 ^ 2, 20) ^ 1.5)",
    167: "sum((close > delay(close, 1)) ? SHIFT : 0, 12)",
    168: "-1 * volume / mean(volume, 20)",
    169: "sma(mean(delay(sma(close - delay(close, 1), 9, 1), 1), 12) - mean(delay(sma(close - delay(close, 1), 9, 1), 1), 26), 10, 1)",
    170: "rank(1 / close) * volume / mean(volume, 20) * (high * rank(high - close) / (sum(high, 5) / 5)) - rank(vwap - delay(vwap, 5))",
    171: "-1 * ((low - close) * (open ^ 5)) / ((close - high) * (close ^ 5))",
    172: "mean(abs(DMINUS - DPLUS) / (DMINUS + DPLUS) * 100, 6)",
    173: "3 * sma(close, 13, 2) - 2 * sma(sma(close, 13, 2), 13, 2) + sma(sma(sma(log(close), 13, 2), 13, 2), 13, 2)",
    174: "sma((close > delay(close, 1)) ? stddev(close, 20) : 0, 20, 1)",
    175: "mean(bigger(bigger(high - low, abs(delay(close, 1) - high)), abs(delay(close, 1) - low)), 6)",
    176: "correlation(rank((close - ts_min(low, 12)) / (ts_max(high, 12) - ts_min(low, 12))), rank(volume), 6)",
    177: "(20 - highday(high, 20)) / 20 * 100",
    178: "(close - delay(close, 1)) / delay(close, 1) * volume",
    179: "rank(correlation(vwap, volume, 4)) * rank(correlation(rank(low), rank(mean(volume, 50)), 12))",
    180: "(mean(volume, 20) < volume) ? (-1 * ts_rank(abs(delta(close, 7)), 60) * bool(delta(close, 7) != 0)) : (-1 * volume)",
    181: "sum((CH1 - mean(CH1, 20)) - ((index_close / delay(index_close, 1) - 1) - mean(index_close / delay(index_close, 1) - 1, 20)) ^ 2, 20) / sum(((index_close / delay(index_close, 1) - 1) - mean(index_close / delay(index_close, 1) - 1, 20)) ^ 3, 20)",
    182: "count(((close > open) && (index_close > index_open)) || ((close < open) && (index_close < index_open)), 20) / 20",
    183: "-1 * (1 / stddev(close, 24)) / cs_min(sum(close - mean(close, 24), 24)) - cs_max(sum(close - mean(close, 24), 24))",
    184: "rank(correlation(delay(open - close, 1), close, 200)) + rank(open - close)",
    185: "rank(-1 * ((1 - open / close) ^ 2))",
    186: "(mean(abs(DMINUS - DPLUS) / (DMINUS + DPLUS) * 100, 6) + delay(mean(abs(DMINUS - DPLUS) / (DMINUS + DPLUS) * 100, 6), 6)) / 2",
    187: "sum(DTM, 20)",
    188: "(high - low - sma(high - low, 11, 2)) / sma(high - low, 11, 2) * 100",
    189: "mean(abs(close - mean(close, 6)), 6)",
    190: "log((count(CH1 > CH19, 20) - 1) * sum((CH1 < CH19) ? (CH1 - CH19) ^ 2 : 0, 20) / (count(CH1 < CH19, 20) * sum((CH1 > CH19) ? (CH1 - CH19) ^ 2 : 0, 20)))",
    191: "correlation(mean(volume, 20), low, 5) + (high + low) / 2 - close",
}

#: Formulas that need a benchmark's columns.
NEED_INDEX = (75, 149, 181, 182)


def formula(number: int) -> str:
    """The text of a formula with its pieces put in."""
    text = FORMULAS[number]
    for name in reversed(PIECES):
        text = _put(text, name, PIECES[name])
    return text


def _put(text: str, name: str, piece: str) -> str:
    import re

    return re.sub(rf"\b{name}\b", lambda _: piece, text)


def alpha(number: int) -> Expr:
    return parse(formula(number))


def residual_30(panel: DataFrame, window: int = 60, least: int = 10) -> DataFrame:
    """Formula 30: mean with weights 1 to 20 of the squared residual of returns on mkt, smb and hml over a rolling window, per code."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("date_")
        y, x = part["ret"].to_numpy(float), np.column_stack([np.ones(len(part)), part[["mkt", "smb", "hml"]].to_numpy(float)])
        whole = np.isfinite(y) & np.isfinite(x).all(axis=1)
        out = np.full(len(part), np.nan)
        for i in range(window - 1, len(part)):
            use = np.flatnonzero(whole[i - window + 1 : i + 1]) + i - window + 1
            if len(use) >= least and whole[i]:
                beta = np.linalg.lstsq(x[use], y[use], rcond=None)[0]
                out[i] = y[i] - x[i] @ beta
        weights = np.arange(1, 21) / 210.0
        value = pd.Series(out**2).rolling(20).apply(lambda v: float(v @ weights), raw=True)
        return pd.DataFrame({"date_": part["date_"].to_numpy(), "code": part["code"].to_numpy(), "alpha_30": value.to_numpy()})

    schema = f"date_ {panel.schema['date_'].dataType.simpleString()}, code {panel.schema['code'].dataType.simpleString()}, alpha_30 double"
    return panel.select("date_", "code", "ret", "mkt", "smb", "hml").groupBy("code").applyInPandas(run, schema)


__all__ = ["FORMULAS", "NEED_INDEX", "PIECES", "alpha", "formula", "residual_30"]
