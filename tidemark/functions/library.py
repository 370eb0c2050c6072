"""Indicators and factors as formulas: data, not code."""

from __future__ import annotations

AMPLITUDE = "((high - low) / ts_delay(close, 1))"
INTRADAY = "((high - low) / close)"
RET = "(close / ts_delay(close, {n}) - 1)"
GAP = "(open / ts_delay(close, 1) - 1)"
TR_SKIP = "greatest(high - low, abs(high - ts_delay(close, 1)), abs(low - ts_delay(close, 1)))"
TYPICAL = "((high + low + close) / 3)"


def _rsi(n: int, mean: str, floor: str) -> str:
    up, down = "if_gt(ts_delta(close, 1), 0, ts_delta(close, 1), 0)", "if_gt(0, ts_delta(close, 1), 0 - ts_delta(close, 1), 0)"
    return f"100 - 100 / (1 + {mean}({up}, {n}) / ({mean}({down}, {n}) + {floor}))"


def _rsv(n: int) -> str:
    return f"(100 * (close - ts_min(low, {n})) / (ts_max(high, {n}) - ts_min(low, {n}) + 0.0000000001))"


PLUS = "if_gt(ts_delta(high, 1), 0, if_gt(ts_delta(high, 1), 0 - ts_delta(low, 1), ts_delta(high, 1), 0), 0)"
MINUS = f"if_gt(0 - ts_delta(low, 1), 0, if_gt(0 - ts_delta(low, 1), {PLUS}, 0 - ts_delta(low, 1), 0), 0)"
DI_PLUS = f"(100 * ts_mean({PLUS}, 14) / (ts_mean({TR_SKIP}, 14) + 0.0000000001))"
DI_MINUS = f"(100 * ts_mean({MINUS}, 14) / (ts_mean({TR_SKIP}, 14) + 0.0000000001))"
DX = f"(100 * abs({DI_PLUS} - {DI_MINUS}) / ({DI_PLUS} + {DI_MINUS} + 0.0000000001))"

#: Windows that need one value.
INDICATORS = {
    **{f"ma{n}": f"ts_mean(close, {n})" for n in (5, 10, 20, 30, 60, 120)},
    **{f"ema{n}": f"ema(close, {n})" for n in (5, 10, 12, 20, 26, 60)},
    **{f"rsi{n}": _rsi(n, "ts_mean", "0.0000000001") for n in (6, 12, 24)},
    "macd_dif": "ema(close, 12) - ema(close, 26)", "macd_dea": "ema(ema(close, 12) - ema(close, 26), 9)",
    "macd_bar": "2 * (ema(close, 12) - ema(close, 26) - ema(ema(close, 12) - ema(close, 26), 9))",
    "boll_mid": "ts_mean(close, 20)", "boll_upper": "ts_mean(close, 20) + 2 * ts_std_pop(close, 20)", "boll_lower": "ts_mean(close, 20) - 2 * ts_std_pop(close, 20)",
    "kdj_k": f"ewm({_rsv(9)}, 0.3333333333333333)", "kdj_d": f"ewm(ewm({_rsv(9)}, 0.3333333333333333), 0.3333333333333333)",
    "kdj_j": f"3 * ewm({_rsv(9)}, 0.3333333333333333) - 2 * ewm(ewm({_rsv(9)}, 0.3333333333333333), 0.3333333333333333)",
    "atr14": f"ts_mean({TR_SKIP}, 14)", "cci14": f"({TYPICAL} - ts_mean({TYPICAL}, 14)) / (0.015 * ts_deviation({TYPICAL}, 14) + 0.0000000001)",
    "obv": "cum_sum(if_gt(ts_delta(close, 1), 0, volume, if_gt(coalesce(ts_delay(close, 1), 0), 0, 0 - volume, 0)))",
    "plus_di": DI_PLUS, "minus_di": DI_MINUS, "adx14": f"ts_mean({DX}, 14)",
    "vol_ratio": "ts_mean(volume, 5) / (ts_mean(volume, 20) + 0.0000000001)", "wr14": "-100 * (ts_max(high, 14) - close) / (ts_max(high, 14) - ts_min(low, 14) + 0.0000000001)",
}
#: Those of the backtest layer: windows must be full, smoothing is adjusted.
BACKTEST_INDICATORS = {
    "bt_sma20": "ts_mean_full(close, 20)", "bt_volume_sma5": "ts_mean_full(volume, 5)", "bt_ema20": "ema_adjusted(close, 20)",
    "bt_high_20": "ts_max_full(high, 20)", "bt_low_20": "ts_min_full(low, 20)", "bt_rsi14": _rsi(14, "ts_mean_full", "0"),
    "bt_boll_upper_20_2": "ts_mean_full(close, 20) + 2 * ts_std_full(close, 20)", "bt_boll_lower_20_2": "ts_mean_full(close, 20) - 2 * ts_std_full(close, 20)",
    "bt_atr14": f"ts_mean_full({TR_SKIP}, 14)", "bt_atr_upper_20_2": f"close + 2 * ts_mean_full({TR_SKIP}, 20)",
    "bt_macd_dif": "ema_adjusted(close, 12) - ema_adjusted(close, 26)",
}

AMP_AMOUNT = f"(amount * {AMPLITUDE})"
#: The selected factors.
FACTORS = {
    "ts_mean_return_div_open": "ts_mean_return(open / amount, 43)", "add_open_delta": "open + ts_delta(ts_sum(volume, 90), 1)",
    "mul_ts_sum_amount": f"ts_sum(amount, 23) * signed_power({INTRADAY}, 3)", "neg_ts_pct_change_abs": "0 - ts_pseudo_return(abs(volume), 71)",
    "mul_signed_power_amplitude": f"signed_power({AMPLITUDE}, 1.5) * amount", "mul_amount_ts_std": f"amount * ts_std(abs({INTRADAY}), 77)",
    "signed_power_ts_maxmin_volume": "signed_power(ts_maxmin(volume, 84), 2)", "ts_maxmin_signed_power_volume": "ts_maxmin(signed_power(volume, 1.5), 111)",
    "mul_abs_amount": f"abs(amount) * {INTRADAY}", "abs_mul_amount": f"abs({AMP_AMOUNT})",
    "sub_sign_ts_std": f"sign(ts_std(ts_skew(ts_zscore({RET.format(n=5)}, 95), 80), 112)) - ts_maxmin(0 - ts_max(amount, 6), 117)",
    "mul_amount_log": f"amount * signed_log({AMPLITUDE})", "ts_dema_mul_amount": f"ts_dema({AMP_AMOUNT}, 13)", "neg_ts_maxmin_volume": "0 - ts_maxmin(volume, 79)",
    "mul_amount_mul": f"amount * ts_dema({AMPLITUDE}, 10) * volume", "ts_std_signed_power_amount": "ts_std(signed_power(amount, 0.5), 5)",
    "ts_maxmin_abs_volume": "ts_maxmin(abs(volume), 91)", "abs_ts_maxmin_sub": "abs(ts_maxmin(volume + 1.893107054794875, 91))",
    "ts_maxmin_add_volume": f"ts_maxmin(volume + {GAP}, 88)", "signed_power_mul_amount": f"signed_power({AMP_AMOUNT}, 0.5)",
    "ts_pct_change_signed_power_mul": "ts_pseudo_return(signed_power(amount * ts_mean_return(low + volume, 56), 1.5), 43)",
    "ts_inverse_cv_delta_amount": "ts_inverse_cv(ts_delta(amount, 1), 85)", "ts_inverse_cv_div_delta": "ts_inverse_cv(ts_delta(amount, 1) / 0.1643122401170105, 85)",
    "log_mul_amplitude": f"signed_log({AMP_AMOUNT})", "ema_ts_dema_delta": f"ema(ts_dema(ts_delta(ts_inverse_cv({AMPLITUDE}, 38), 1), 3), 103)",
    "sub_ts_median_clip": f"ts_median(clip(low, -3, 3), 65) - {AMP_AMOUNT}", "div_ts_inverse_cv_volume": "ts_inverse_cv(volume, 5) / amount",
}


def plugin_factors(n: int = 5) -> dict[str, str]:
    """The plug-in factors for a period of n rows."""
    h, low = "if_gt(ts_delta(high, 1), 0, ts_delta(high, 1), 0)", "if_gt(0, ts_delta(low, 1), 0 - ts_delta(low, 1), 0)"
    xpdm = f"if_gt({h}, {low}, {h} - ts_delay({h}, 1), 0)"
    di = f"(ts_sum({xpdm}, {n}) / ts_sum(greatest(abs(high - low), abs(high - close), abs(low - close)), {n}))"
    ma, ma2, hl = f"ts_mean_full(close, {n})", f"ts_mean_full(close, {2 * n})", "((high + low) / 2)"
    mid = lambda k: f"((ts_max(high, {k}) + ts_min(low, {k})) / 2)"
    wc = "((high + low + 2 * close) / 4)"
    down = "if_gt(ts_delay(close, 1), close, {x}, 0)"
    return {
        "adxrpos": f"0.5 * {di} + 0.5 * ts_delay({di}, {n})", "alpha95": f"ts_std_full(amount, {n}) * ts_std_full(amount, {2 * n}) * ts_std_full(amount, {4 * n})",
        "ax10": f"100000000 * ts_mean(close / (ts_mean(ts_mean({hl}, {n}), {n}) + 0.00000001) - 1, {n})", "cret": f"ts_delay(close / ts_delay(close, {2 * n}) - 1, {n})",
        "copp_atr": f"ts_mean(100 * ({RET.format(n=n)} + {RET.format(n=2 * n)}), {n}) * (ts_mean({TR_SKIP}, {n}) / {ma})", "g135": "ts_mean_full(ts_delay(close / ts_delay(close, 20), 1), 20)",
        "g144": f"ts_sum({down.format(x=f'abs({RET.format(n=1)}) / amount')}, 20) / ts_sum({down.format(x='1')}, 20)", "g161": f"ts_mean_full({TR_SKIP}, 12)",
        "g167": "ts_sum_full(if_gt(ts_delta(close, 1), 0, ts_delta(close, 1), 0), 12)",
        "g187": "ts_sum_full(if_gt(ts_delay(open, 1), open, 0, if_gt(open, ts_delay(open, 1), greatest(high - open, ts_delta(open, 1)), if_gt(coalesce(ts_delay(open, 1), 0 - 1), 0, 0, high - open))), 20)",
        "g189": "ts_mean_full(abs(close - ts_mean_full(close, 6)), 6)", "ic": f"(({mid(n)} + {mid(3 * n)}) / 2) / {mid(6 * n)}",
        "ma_displaced": f"close / ts_delay({ma2}, {n}) - 1", "mak": f"ts_mean_full(({ma} / ts_delay({ma}, 1) - 1) * 1000, {n})", "mm": f"{ma} / (ts_mean_full(close, {5 * n}) + 0.00000001) - 1",
        "mtm_hcm": f"ts_mean(high / ts_delay(high, {n}) - 1, {n}) / (close / ts_mean(close, {n})) - 1", "po": f"({ma} - ts_mean_full(close, {3 * n})) / ts_mean_full(close, {3 * n}) * 100",
        "ppo": f"ts_mean_full(({ma} / ts_delay({ma}, {n}) - 1) * abs({ma2} / ts_delay({ma2}, {2 * n}) - 1), {n})", "price_vol": f"ts_std_full(close, {n})",
        "sroc": f"({ma} - ts_delay({ma}, {2 * n})) / (ts_delay({ma}, {2 * n}) + 0.00000001)", "trv": f"ts_mean_full(100 * ({ma} - ts_delay({ma}, {n})) / ts_delay({ma}, {n}), {n})",
        "wc": f"ts_mean_full({wc}, {n}) / (ts_mean_full({wc}, {2 * n}) + 0.00000001) - 1",
    }


#: The factors that a new store begins with, by name: category and formula.
SEEDS = {
    "price_vol_20": ("量价", "ts_std(close, 20)"),
    "ma_displaced_20": ("动量", "close / ts_delay(ts_mean(close, 40), 20) - 1"),
    "c_ret_10": ("反转", "ts_delay(close / ts_delay(close, 20) - 1, 10)"),
    "mtm_hcm_20": ("动量", "ts_mean(close / ts_delay(close, 20) - 1, 20) / (close / ts_mean(close, 20)) - 1"),
    "alpha95_v2_10": ("波动", "ts_std(close, 10) * ts_std(close, 20) * ts_std(close, 40)"),
    "sroc_20": ("动量", "(ts_mean(close, 20) - ts_delay(ts_mean(close, 20), 40)) / ts_delay(ts_mean(close, 20), 40)"),
    "mak_v2_20": ("动量", "ts_mean((ts_mean(close, 20) / ts_delay(ts_mean(close, 20), 1) - 1) * 1000, 20)"),
    "mm_20": ("动量", "ts_mean(close, 20) / ts_mean(close, 100) - 1"),
    "po_20": ("动量", "(ts_mean(close, 20) - ts_mean(close, 60)) / ts_mean(close, 60) * 100"),
    "trv_20": ("趋势", "ts_mean(100 * (ts_mean(close, 20) - ts_delay(ts_mean(close, 20), 20)) / ts_delay(ts_mean(close, 20), 20), 20)"),
    "g_161": ("波动", "ts_mean(max_df(max_df(high - low, abs(ts_delay(close, 1) - high)), abs(ts_delay(close, 1) - low)), 12)"),
    "copp_atr_20": ("波动", "ts_mean(100 * ((close - ts_delay(close, 20)) / ts_delay(close, 20) + (close - ts_delay(close, 40)) / ts_delay(close, 40)), 20) * (ts_mean(tr(high, low, close), 20) / ts_mean(close, 20))"),
    "wc_20": ("趋势", "ts_mean((high + low + 2 * close) / 4, 20) / ts_mean((high + low + 2 * close) / 4, 40) - 1"),
}

#: Templates that a search expands over windows.
TEMPLATES = {"momentum": "close / ts_delay(close, {n}) - 1", "reversal": "0 - (close / ts_delay(close, {n}) - 1)", "volatility": "ts_std(close / ts_delay(close, 1) - 1, {n})", "volume_surge": "volume / ts_mean(volume, {n})", "range_position": "ts_maxmin(close, {n})", "price_volume": "ts_corr(close, volume, {n})", "trend": "ts_zscore(close, {n})", "skewness": "ts_skew(close / ts_delay(close, 1) - 1, {n})"}


def expand(templates: dict[str, str], windows: list[int]) -> dict[str, str]:
    return {f"{name}_{n}": text.format(n=n) for name, text in templates.items() for n in windows}
