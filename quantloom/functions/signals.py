"""Published accounting and price signals of monthly panels, in plain text.

Fixed values. A panel has a row per code and month; what is known of a year's or quarter's report stands in
all months until the next. ``delay(x, 12)`` is a year before. Columns: ``market`` (equity value), ``assets``,
``liabilities``, ``equity`` (common), ``all_equity`` (with preferred), ``current_assets``, ``current_debts``, ``cash``, ``short_debt``, ``long_debt``,
``inventory``, ``receivables``, ``plant`` (gross), ``plant_net``, ``sales``, ``costs``, ``overhead``, ``interest``, ``income`` (before
extraordinary items), ``net_income``, ``operating_income`` (before depreciation), ``depreciation``, ``tax``, ``tax_payable``, ``deferred_tax``,
``preferred``, ``capex``, ``research``, ``advertising``, ``employees``, ``dividends``, ``buybacks``, ``issues``, ``debt_issues``, ``debt_paid``, ``operating_cash``,
``long_investments``, ``short_investments``, ``minority``, ``intangibles``, ``deferred_revenue``, ``backlog``, ``payables``, ``securities``, ``price``, ``shares``, ``traded``, ``short_interest``,
``estimate``, ``estimate_spread``, ``actual``, ``growth_forecast``, ``dividend``, ``high_price``, ``ret``; a suffix ``_q`` marks a quarter's own. Filters by exchange,
listing or industry code are screens of the panel, and not part of a signal.
"""

from __future__ import annotations

import re

from quantloom.functions.dsl import parse
from quantloom.functions.expr import Expr


def grown(first: int, last: int) -> str:
    """Compounded return of the months from ``first`` to ``last`` back; missing months count as none."""
    return "(" + " * ".join(f"(1 + R{k})" for k in range(first, last + 1)) + " - 1)"


def mean_of(months: list[int]) -> str:
    return "((" + " + ".join(f"R{k}" for k in months) + f") / {len(months)})"


#: Pieces that signals share, by name.
PIECES: dict[str, str] = {
    "AVERAGE_ASSETS": "((assets + delay(assets, 12)) / 2)",
    "WORKING": "(current_assets - cash - (current_debts - short_debt))",
    "LONG_NET": "((assets - current_assets - fillna(long_investments, 0)) - (liabilities - fillna(short_debt, 0) - fillna(long_debt, 0)))",
    "FINANCIAL": "(fillna(short_investments, 0) + fillna(long_investments, 0) - (fillna(long_debt, 0) + fillna(short_debt, 0) + fillna(preferred, 0)))",
    "OPERATING_NET": "((assets - cash) - (assets - fillna(long_debt, 0) - fillna(minority, 0) - fillna(short_debt, 0) - fillna(preferred, 0) - equity))",
    "ACCRUED": "((current_assets - delay(current_assets, 12)) - (cash - delay(cash, 12)) - ((current_debts - delay(current_debts, 12)) - (short_debt - delay(short_debt, 12)) - (fillna(tax_payable, 0) - delay(fillna(tax_payable, 0), 12))) - depreciation)",
    "BOOK": "(all_equity + fillna(deferred_tax, 0) - fillna(preferred, 0))",
    "TURN": "(sales / ((TURN_BASE + delay(TURN_BASE, 12)) / 2))",
    "TURN_BASE": "(receivables + inventory + ffill(plant_net) + intangibles - payables)",
    "GROSS": "(sales - costs)",
    "QUARTER_GAP": "(actual - delay(actual, 12))",
}

FORMULAS: dict[str, str] = {
    # prices to accounts
    "AM": "assets / market",
    "BM": "log(equity / delay(market, 6))",
    "BMdec": "BOOK / delay(market, 6)",
    "EP": "where(income / delay(market, 6), income / delay(market, 6) >= 0)",
    "SP": "sales / market",
    "CF": "(income + depreciation) / market",
    "cfp": "ifelse(notna(operating_cash), operating_cash, income - ACCRUED) / market",
    "Leverage": "liabilities / market",
    "BookLeverage": "assets / BOOK",
    "EntMult": "where((market + long_debt + short_debt + preferred - cash) / operating_income, (equity >= 0) && (operating_income >= 0))",
    "RD": "research / market",
    "AdExp": "where(advertising / market, advertising > 0)",
    "NetDebtPrice": "(long_debt + short_debt + preferred - cash) / market",
    "NetPayoutYield": "(dividends + buybacks - issues) / delay(market, 6)",
    "PayoutYield": "where((dividends + buybacks + preferred) / delay(market, 6), dividends + buybacks + preferred > 0)",
    "CashProd": "(market - assets) / cash",
    "Size": "log(market)",
    "Price": "log(abs(price))",
    # growth and investment
    "AssetGrowth": "(assets - delay(assets, 12)) / delay(assets, 12)",
    "ChEQ": "where(equity / delay(equity, 12), (equity > 0) && (delay(equity, 12) > 0))",
    "ChInv": "(inventory - delay(inventory, 12)) / AVERAGE_ASSETS",
    "InvGrowth": "inventory / delay(inventory, 12) - 1",
    "InvestPPEInv": "((plant - delay(plant, 12)) + (inventory - delay(inventory, 12))) / delay(assets, 12)",
    "Investment": "where((capex / sales) / ts_mean(capex / sales, 36, 24), sales >= 10)",
    "hire": "fillna((employees - delay(employees, 12)) / (0.5 * (employees + delay(employees, 12))), 0)",
    "grcapx": "capex / delay(capex, 24) - 1",
    "grcapx1y": "delay(capex, 12) / delay(capex, 24) - 1",
    "grcapx3y": "capex / ((delay(capex, 12) + delay(capex, 24) + delay(capex, 36)) / 3)",
    "GrAdExp": "where(log(advertising) - delay(log(advertising), 12), advertising >= 0.1)",
    "GrSaleToGrInv": "(sales - 0.5 * (delay(sales, 12) + delay(sales, 24))) / (0.5 * (delay(sales, 12) + delay(sales, 24))) - (inventory - 0.5 * (delay(inventory, 12) + delay(inventory, 24))) / (0.5 * (delay(inventory, 12) + delay(inventory, 24)))",
    "GrSaleToGrOverhead": "(sales - 0.5 * (delay(sales, 12) + delay(sales, 24))) / (0.5 * (delay(sales, 12) + delay(sales, 24))) - (overhead - 0.5 * (delay(overhead, 12) + delay(overhead, 24))) / (0.5 * (delay(overhead, 12) + delay(overhead, 24)))",
    "GrSaleToGrReceivables": "(sales - 0.5 * (delay(sales, 12) + delay(sales, 24))) / (0.5 * (delay(sales, 12) + delay(sales, 24))) - (receivables - 0.5 * (delay(receivables, 12) + delay(receivables, 24))) / (0.5 * (delay(receivables, 12) + delay(receivables, 24)))",
    "MeanRankRevGrowth": "(5 * delay(GROWTH_RANK, 12) + 4 * delay(GROWTH_RANK, 24) + 3 * delay(GROWTH_RANK, 36) + 2 * delay(GROWTH_RANK, 48) + delay(GROWTH_RANK, 60)) / 15",
    "sgr": "sales / delay(sales, 12) - 1",
    "dNoa": "(OPERATING_NET - delay(OPERATING_NET, 12)) / delay(assets, 12)",
    "NOA": "OPERATING_NET / delay(assets, 12)",
    "realestate": "plant_net / plant - group_mean(plant_net / plant)",
    # accruals and balance sheet changes
    "Accruals": "ACCRUED / AVERAGE_ASSETS",
    "AccrualsBM": "where(bool((bucketize_quantiles(log(equity / market), 5) == 5) && (bucketize_quantiles(ACCRUED / AVERAGE_ASSETS, 5) == 1)), (equity >= 0) && (((bucketize_quantiles(log(equity / market), 5) == 5) && (bucketize_quantiles(ACCRUED / AVERAGE_ASSETS, 5) == 1)) || ((bucketize_quantiles(log(equity / market), 5) == 1) && (bucketize_quantiles(ACCRUED / AVERAGE_ASSETS, 5) == 5))))",
    "PctAcc": "ifelse(income == 0, (income - operating_cash) / 0.01, (income - operating_cash) / abs(income))",
    "PctTotAcc": "(net_income - (buybacks - issues + dividends + operating_cash)) / abs(net_income)",
    "TotalAccruals": "((WORKING - delay(WORKING, 12)) + (LONG_NET - delay(LONG_NET, 12)) + (FINANCIAL - delay(FINANCIAL, 12))) / delay(assets, 12)",
    "ChNNCOA": "LONG_NET / assets - delay(LONG_NET / assets, 12)",
    "ChNWC": "where(WORKING / assets - delay(WORKING / assets, 12), assets > 0)",
    "DelCOA": "((current_assets - cash) - (delay(current_assets, 12) - delay(cash, 12))) / AVERAGE_ASSETS",
    "DelCOL": "((current_debts - short_debt) - (delay(current_debts, 12) - delay(short_debt, 12))) / AVERAGE_ASSETS",
    "DelDRC": "(deferred_revenue - delay(deferred_revenue, 12)) / AVERAGE_ASSETS",
    "DelEqu": "(equity - delay(equity, 12)) / AVERAGE_ASSETS",
    "DelFINL": "((long_debt + short_debt + fillna(preferred, 0)) - delay(long_debt + short_debt + fillna(preferred, 0), 12)) / AVERAGE_ASSETS",
    "DelLTI": "(long_investments - delay(long_investments, 12)) / AVERAGE_ASSETS",
    "DelSTI": "(short_investments - delay(short_investments, 12)) / AVERAGE_ASSETS",
    "DelNetFin": "(FINANCIAL - delay(FINANCIAL, 12)) / AVERAGE_ASSETS",
    "ChNCOA": "((assets - current_assets - long_investments) - delay(assets - current_assets - long_investments, 12)) / delay(assets, 12)",
    "ChNCOL": "((liabilities - current_debts - long_debt) - delay(liabilities - current_debts - long_debt, 12)) / delay(assets, 12)",
    "GrLTNOA": "(RECEIVED - delay(RECEIVED, 12)) / AVERAGE_ASSETS - ((receivables - delay(receivables, 12)) + (inventory - delay(inventory, 12)) - (payables - delay(payables, 12)) - depreciation) / AVERAGE_ASSETS",
    # profits
    "GP": "GROSS / assets",
    "GPlag": "GROSS / delay(assets, 12)",
    "OperProf": "(GROSS - overhead - interest) / equity",
    "OperProfLag": "(GROSS - overhead - interest) / delay(equity, 12)",
    "OperProfRD": "(GROSS - overhead + fillna(research, 0)) / assets",
    "OperProfRDLagAT": "(GROSS - overhead + fillna(research, 0)) / delay(assets, 12)",
    "CBOperProf": "(GROSS - (overhead - fillna(research, 0)) - (receivables - delay(receivables, 12)) - (inventory - delay(inventory, 12)) + (deferred_revenue - delay(deferred_revenue, 12)) + (payables - delay(payables, 12))) / assets",
    "CBOperProfLagAT": "(GROSS - (overhead - fillna(research, 0)) - (receivables - delay(receivables, 12)) - (inventory - delay(inventory, 12)) + (deferred_revenue - delay(deferred_revenue, 12)) + (payables - delay(payables, 12))) / delay(assets, 12)",
    "RoE": "net_income / equity",
    "roaq": "income_q / delay(assets_q, 3)",
    "ChTax": "(tax_q - delay(tax_q, 12)) / delay(assets, 12)",
    "Cash": "cash_q / assets_q",
    "Tax": "ifelse(income <= 0, 1, tax / 0.35 / income)",
    "OPLeverage": "(overhead + costs) / assets",
    "AssetTurnover": "where(TURN, TURN >= 0)",
    "ChAssetTurnover": "where(TURN, TURN >= 0) - delay(where(TURN, TURN >= 0), 12)",
    "CapTurnover": "sales / delay(assets, 12)",
    "PM": "net_income / sales",
    "ChPM": "net_income / sales - delay(net_income / sales, 12)",
    "RetNOA": "(operating_income - depreciation) / delay(OPERATING_NET, 12)",
    "ChangeRoA": "income_q / delay(assets_q, 3) - delay(income_q / delay(assets_q, 3), 12)",
    "ChangeRoE": "income_q / equity_q - delay(income_q / equity_q, 12)",
    "roavol": "ts_std(income_q / delay(assets_q, 3), 48, 1, 24)",
    "roic": "(operating_income - depreciation) / (equity + liabilities - cash)",
    "ETR": "(tax / income - (delay(tax / income, 12) + delay(tax / income, 24) + delay(tax / income, 36)) / 3) * (income / market)",
    "NumEarnIncrease": "EARN_UP + EARN_UP * delay(EARN_UP, 3) + EARN_UP * delay(EARN_UP, 3) * delay(EARN_UP, 6) + EARN_UP * delay(EARN_UP, 3) * delay(EARN_UP, 6) * delay(EARN_UP, 9)",
    "VarCF": "ts_var((income + depreciation) / market, 60, 1, 24)",
    "EarningsSurprise": "(QUARTER_GAP - GAP_DRIFT) / ts_std(QUARTER_GAP - GAP_DRIFT, 24, 1, 12)",
    "RevenueSurprise": "(sales_q / shares - delay(sales_q / shares, 12)) / ts_std(sales_q / shares - delay(sales_q / shares, 12), 24, 1, 12)",
    "EarningsConsistency": "ts_mean(where(QUARTER_GAP / ((abs(delay(actual, 12)) + abs(delay(actual, 24))) / 2), notna(delay(actual, 24))), 24, 12)",
    # financing
    "NetDebtFinance": "where((debt_issues - debt_paid) / AVERAGE_ASSETS, abs((debt_issues - debt_paid) / AVERAGE_ASSETS) <= 1)",
    "NetEquityFinance": "where((issues - buybacks - dividends) / AVERAGE_ASSETS, abs((issues - buybacks - dividends) / AVERAGE_ASSETS) <= 1)",
    "XFIN": "(issues - dividends - buybacks + debt_issues - debt_paid) / assets",
    "DebtIssuance": "bool(debt_issues > 0)",
    "ConvDebt": "bool((preferred > 0) || (securities > 0))",
    "CompositeDebtIssuance": "log((long_debt + short_debt) / delay(long_debt + short_debt, 60))",
    "CompEquIss": "log(market / delay(market, 60)) - " + grown(0, 59),
    "ShareIss1Y": "(delay(shares, 6) - delay(shares, 18)) / delay(shares, 18)",
    "ShareIss5Y": "(delay(shares, 5) - delay(shares, 65)) / delay(shares, 65)",
    "ShareRepurchase": "where(bool(buybacks > 0), notna(buybacks))",
    "DivInit": "bool((dividend > 0) && (delay(ts_sum(fillna(dividend, 0), 24, 1), 1) == 0))",
    "DivOmit": "bool((dividend == 0) && (delay(ts_sum(fillna(dividend, 0), 3, 1), 1) > 0))",
    "DivSeason": "bool((delay(dividend, 2) > 0) || (delay(dividend, 5) > 0) || (delay(dividend, 8) > 0) || (delay(dividend, 11) > 0))",
    "DivYield": "ts_sum(fillna(dividend, 0), 12) / abs(price)",
    "DivYieldST": "delay(dividend, 2) / abs(price)",
    # research, brands, orders
    "RDcap": "(fillna(research, 0) + 0.8 * delay(fillna(research, 0), 12) + 0.6 * delay(fillna(research, 0), 24) + 0.4 * delay(fillna(research, 0), 36) + 0.2 * delay(fillna(research, 0), 48)) / assets",
    "SurpriseRD": "where(bool((research / sales > 0) && (research / assets > 0) && (research / delay(research, 12) > 1.05) && ((research / assets) / (delay(research, 12) / delay(assets, 12)) > 1.05)), notna(research))",
    "BrandCapital": "(fillna(advertising, 0) + 0.5 * delay(fillna(advertising, 0), 12) + 0.25 * delay(fillna(advertising, 0), 24) + 0.125 * delay(fillna(advertising, 0), 36)) / assets",
    "BrandInvest": "advertising / delay(fillna(advertising, 0) + 0.5 * delay(fillna(advertising, 0), 12) + 0.25 * delay(fillna(advertising, 0), 24), 12)",
    "OrgCap": "(overhead + 0.85 * delay(overhead, 12) + 0.7225 * delay(overhead, 24) + 0.614125 * delay(overhead, 36)) / assets",
    "OrderBacklog": "where(backlog / AVERAGE_ASSETS, backlog != 0)",
    "OrderBacklogChg": "where(backlog / AVERAGE_ASSETS, backlog != 0) - delay(where(backlog / AVERAGE_ASSETS, backlog != 0), 12)",
    "rd_sale": "delay(research, 12) / delay(sales, 12)",
    "tang": "(cash + 0.715 * receivables + 0.547 * inventory + 0.535 * plant) / assets",
    # ratios
    "cashdebt": "(income + depreciation) / ((liabilities + delay(liabilities, 12)) / 2)",
    "currat": "current_assets / current_debts",
    "pchcurrat": "(current_assets / current_debts) / delay(current_assets / current_debts, 12) - 1",
    "quick": "(current_assets - inventory) / current_debts",
    "pchquick": "((current_assets - inventory) / current_debts) / delay((current_assets - inventory) / current_debts, 12) - 1",
    "depr": "depreciation / plant_net",
    "pchdepr": "(depreciation / plant_net) / delay(depreciation / plant_net, 12) - 1",
    "saleinv": "sales / inventory",
    "pchsaleinv": "(sales / inventory) / delay(sales / inventory, 12) - 1",
    "salecash": "sales / cash",
    "salerec": "sales / receivables",
    "pchgm_pchsale": "(GROSS - delay(GROSS, 12)) / delay(GROSS, 12) - (sales - delay(sales, 12)) / delay(sales, 12)",
    "secured": "securities / long_debt",
    "securedind": "bool(securities > 0)",
    "LaborforceEfficiency": "(sales / employees) / delay(sales / employees, 12) - 1",
    "AssetLiquidityBook": "(cash + 0.75 * (current_assets - cash) + 0.5 * (assets - current_assets - intangibles)) / delay(assets, 12)",
    "AssetLiquidityMarket": "(cash + 0.75 * (current_assets - cash) + 0.5 * (assets - current_assets - intangibles)) / (delay(market, 12) + delay(assets, 12) - delay(equity, 12))",
    "ZScore": "1.2 * (current_assets - current_debts) / assets + 1.4 * (all_equity / assets) + 3.3 * (net_income + interest + tax) / assets + 0.6 * (market / liabilities) + sales / assets",
    "KZ": "-1.002 * (income + depreciation) / assets + 0.283 * (assets + market - equity - deferred_tax) / assets + 3.319 * (short_debt + long_debt) / (short_debt + long_debt + all_equity) - 39.368 * (dividends / assets) - 1.315 * (cash / assets)",
    "WW": "-0.091 * (income + depreciation) / assets - 0.062 * bool(dividends > 0) + 0.021 * long_debt / assets - 0.044 * log(assets) + 0.102 * (group_sum(sales) / delay(group_sum(sales), 12) - 1) - 0.035 * (sales / delay(sales, 12) - 1)",
    "PS": "bool(income > 0) + bool(operating_cash > 0) + bool(income / assets > delay(income, 12) / delay(assets, 12)) + bool(operating_cash > income) + bool(long_debt / assets < delay(long_debt, 12) / delay(assets, 12)) + bool(current_assets / current_debts > delay(current_assets, 12) / delay(current_debts, 12)) + bool(GROSS / sales > delay(GROSS, 12) / delay(sales, 12)) + bool(sales / assets > delay(sales, 12) / delay(assets, 12)) + bool(shares <= delay(shares, 12))",
    # quarters
    "AMq": "assets_q / market",
    "BMq": "log(equity_q / market)",
    "CFq": "(income_q + depreciation) / market",
    "EPq": "where(income_q / delay(market, 6), income_q >= 0)",
    "SP_q": "sales_q / market",
    "sgr_q": "sales_q / delay(sales_q, 12) - 1",
    "AssetGrowth_q": "(assets_q - delay(assets_q, 12)) / delay(assets_q, 12)",
    "BookLeverageQuarterly": "assets_q / equity_q",
    "PM_q": "income_q / sales_q",
    "Tax_q": "tax_q / income_q",
    # concentration
    "Herf": "ts_mean(group_sum((sales / group_sum(sales)) ^ 2), 36, 12)",
    "HerfAsset": "ts_mean(group_sum((assets / group_sum(assets)) ^ 2), 36, 12)",
    "HerfBE": "ts_mean(group_sum((BOOK / group_sum(BOOK)) ^ 2), 36, 12)",
    "ChInvIA": "(capex - 0.5 * (delay(capex, 12) + delay(capex, 24))) / (0.5 * (delay(capex, 12) + delay(capex, 24))) - group_mean((capex - 0.5 * (delay(capex, 12) + delay(capex, 24))) / (0.5 * (delay(capex, 12) + delay(capex, 24))))",
    # past returns
    "Mom6m": grown(1, 5),
    "Mom12m": grown(1, 11),
    "IntMom": grown(7, 12),
    "MRreversal": grown(13, 18),
    "LRreversal": grown(13, 36),
    "STreversal": "R0",
    "FirmAgeMom": "where(" + grown(1, 5) + ", rank(cumcount(price)) <= 0.2)",
    "MomRev": "where(bool((bucketize_quantiles(" + grown(1, 5) + ", 5) == 5) && (bucketize_quantiles(" + grown(13, 36) + ", 5) == 1)), ((bucketize_quantiles(" + grown(1, 5) + ", 5) == 5) && (bucketize_quantiles(" + grown(13, 36) + ", 5) == 1)) || ((bucketize_quantiles(" + grown(1, 5) + ", 5) == 1) && (bucketize_quantiles(" + grown(13, 36) + ", 5) == 5)))",
    "MomSeasonShort": "R11",
    "MomSeason": mean_of([23, 35, 47, 59]),
    "MomOffSeason": mean_of([k for k in range(12, 60) if k not in (23, 35, 47, 59)]),
    "Mom12mOffSeason": mean_of(list(range(1, 11))),
    "IndMom": "group_mean(" + grown(1, 5) + ")",
    "High52": "abs(price) / ts_max(high_price, 12)",
    "MaxRet": "ts_max(ret, 1)",
    "ReturnSkew": "ts_skew(ret, 12, 6)",
    "FirmAge": "cumcount(price)",
    # trading
    "DolVol": "log(delay(traded, 2) * abs(delay(price, 2)))",
    "Illiquidity": "ts_mean(abs(ret) / (abs(price) * traded), 12, 6)",
    "ShareVol": "ts_sum(traded, 3) / (3 * shares)",
    "VolMkt": "ts_mean(traded * abs(price), 12, 6) / market",
    "VolSD": "ts_std(traded, 36, 1, 24)",
    "std_turn": "ts_std(traded / shares, 36, 1, 24)",
    "VolumeTrend": "ts_slope(traded, 12) / ts_mean(traded, 12)",
    "ShortInterest": "short_interest / shares",
    "Beta": "ts_beta(ret, cs_mean(ret), 36, 20)",
    "BetaSquared": "ts_beta(ret, cs_mean(ret), 36, 20) ^ 2",
    "Coskewness": "ts_mean((ret - ts_mean(ret, 36, 20)) * (cs_mean(ret) - ts_mean(cs_mean(ret), 36, 20)) ^ 2, 36, 20) / (rolling_std(ret, 36) * rolling_std(cs_mean(ret), 36) ^ 2)",
    "IdioVol": "rolling_std(ret - cs_mean(ret), 12)",
    # analysts
    "FEPS": "estimate",
    "AnalystRevision": "estimate / delay(estimate, 1)",
    "ForecastDispersion": "estimate_spread / abs(estimate)",
    "REV6": "ts_sum((estimate - delay(estimate, 1)) / abs(delay(price, 1)), 6)",
    "sfe": "estimate / abs(price)",
    "EarningsForecastDisparity": "growth_forecast - 100 * (estimate - actual) / abs(actual)",
    "fgr5yrLag": "delay(growth_forecast, 6)",
    "fgr5yrNoLag": "growth_forecast",
    "EarningsStreak": "where((actual - estimate) / price, sign(actual - estimate) == sign(delay(actual - estimate, 3)))",
    "ExclExp": "cs_winsorize(actual - income_q / shares)",
}

#: Further pieces, which use those above.
PIECES |= {
    "GROWTH_RANK": "cs_rank_raw(log(sales) - log(delay(sales, 12)))",
    "RECEIVED": "(receivables + inventory + plant_net + intangibles - payables)",
    "EARN_UP": "bool(income_q - delay(income_q, 12) > 0)",
    "GAP_DRIFT": "ts_mean(delay(QUARTER_GAP, 3), 24, 12)",
}


def text(name: str) -> str:
    """A signal's formula with its pieces put in."""
    out = FORMULAS[name]
    while (named := re.search(r"\b(" + "|".join(sorted(PIECES, key=len, reverse=True)) + r")\b", out)) is not None:
        out = out[: named.start()] + PIECES[named[1]] + out[named.end() :]
    return re.sub(r"\bR(\d+)\b", lambda m: f"delay(fillna(ret, 0), {m[1]})" if m[1] != "0" else "fillna(ret, 0)", out)


def signal(name: str) -> Expr:
    return parse(text(name))
