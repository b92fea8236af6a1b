"""Contracts of the landed tables that are conformed as they are: key, the column a row must have, and columns by kind.

Days are the text columns whose names end in `date`; they are stored as 8 digits.
"""

from __future__ import annotations

from barloom.sources.contracts import BLOCK_TRADE, FACTOR, KLINE_DAILY, LOG_MISSING, REPORT_INCOME, SNAPSHOT, Contract

Names = tuple[str, ...]


def _table(name: str, key: Names, day: str, text: Names, number: Names = (), whole: Names = (), moment: Names = (), **rules) -> Contract:
    kinds = (("string", text), ("double", number), ("int", whole), ("timestamp", moment))
    columns = ", ".join(f"`{c}` {kind}" for kind, names in kinds for c in names)
    return Contract(name, key, columns, day, tuple(c for c in text if c.endswith("date")), **rules)


# Tables, keys and column names.
TABLES = (
    _table(
        "financial_audit", ("ts_code", "end_date"), "end_date",
        text=("ts_code", "ann_date", "end_date", "audit_result", "audit_agency", "audit_sign"),
        number=("audit_fees",),
    ),
    _table(
        "financial_disclosure_date", ("ts_code", "end_date"), "end_date",
        text=("ts_code", "ann_date", "end_date", "pre_date", "actual_date", "modify_date"),
    ),
    _table(
        "financial_express", ("ts_code", "end_date"), "end_date",
        text=("ts_code", "ann_date", "end_date"),
        number=(
            "revenue", "operate_profit", "total_profit", "n_income", "total_assets", "total_hldr_eqy_exc_min_int",
            "diluted_eps", "diluted_roe", "yoy_net_profit", "bps", "yoy_sales", "yoy_op", "yoy_tp", "yoy_dedu_np",
            "yoy_eps", "yoy_roe", "growth_assets", "yoy_equity",
        ),
    ),
    _table(
        "financial_fina_mainbz", ("ts_code", "end_date", "bz_item", "bz_code"), "end_date",
        text=("ts_code", "end_date", "bz_item", "bz_code", "curr_type", "update_flag"),
        number=("bz_sales", "bz_profit", "bz_cost"),
    ),
    _table(
        "financial_forecast", ("ts_code", "end_date", "ann_date"), "end_date",
        text=("ts_code", "ann_date", "end_date", "type", "first_ann_date", "summary", "change_reason"),
        number=("p_change_min", "p_change_max", "net_profit_min", "net_profit_max", "last_parent_net"),
    ),
    _table(
        "financial_report_balance", ("ts_code", "end_date", "f_ann_date", "report_type", "update_flag"), "end_date",
        text=(
            "ts_code", "ann_date", "f_ann_date", "end_date", "report_type", "comp_type", "end_type", "update_flag",
            "balance_table",
        ),
        number=(
            "money_cap", "trad_asset", "accounts_receiv_bill", "notes_receiv", "accounts_receiv", "receiv_financing",
            "oth_rcv_total", "inventories", "contract_assets", "oth_cur_assets", "total_cur_assets", "lt_eqt_invest",
            "invest_real_estate", "fix_assets", "cip", "use_right_assets", "intan_assets", "amor_exp",
            "defer_tax_assets", "oth_nca", "total_nca", "total_assets", "lt_borr", "bond_payable", "lease_liab",
            "deferred_inc", "total_ncl", "total_liab", "st_borr", "total_share", "oth_eqt_tools", "cap_rese",
            "surplus_rese", "undistr_porfit", "treasury_share", "total_hldr_eqy_exc_min_int", "minority_int",
            "total_hldr_eqy_inc_min_int", "total_liab_hldr_eqy",
        ),
    ),
    _table(
        "financial_report_cashflow", ("ts_code", "end_date", "f_ann_date", "report_type", "update_flag"), "end_date",
        text=(
            "ts_code", "ann_date", "f_ann_date", "end_date", "report_type", "comp_type", "end_type", "update_flag",
            "cashflow_table",
        ),
        number=(
            "c_fr_sale_sg", "n_depos_incr_fi", "ifc_cash_incr", "c_fr_oth_operate_a", "c_inf_fr_operate_a",
            "c_paid_goods_s", "n_incr_clt_loan_adv", "n_incr_dep_cbob", "pay_handling_chrg", "c_paid_to_for_empl",
            "c_paid_for_taxes", "oth_cash_pay_oper_act", "st_cash_out_act", "n_cashflow_act", "c_disp_withdrwl_invest",
            "c_recp_return_invest", "n_recp_disp_fiolta", "oth_recp_ral_inv_act", "stot_inflows_inv_act",
            "c_pay_acq_const_fiolta", "c_paid_invest", "oth_pay_ral_inv_act", "stot_out_inv_act", "n_cashflow_inv_act",
            "stot_cash_in_fnc_act", "c_pay_dist_dpcp_int_exp", "incl_dvd_profit_paid_sc_ms", "oth_cashpay_ral_fnc_act",
            "stot_cashout_fnc_act", "n_cash_flows_fnc_act", "eff_fx_flu_cash", "n_incr_cash_cash_equ",
            "c_cash_equ_beg_period", "c_cash_equ_end_period",
        ),
    ),
    _table(
        "financial_report_indicator", ("ts_code", "end_date", "ann_date", "update_flag"), "end_date",
        text=("ts_code", "ann_date", "end_date", "update_flag", "indicator_table"),
        number=(
            "eps", "dt_eps", "bps", "ocfps", "cfps", "roe", "roe_dt", "roa", "grossprofit_margin", "netprofit_margin",
            "current_ratio", "quick_ratio", "debt_to_assets", "ar_turn", "assets_turn", "op_yoy", "dt_netprofit_yoy",
            "tr_yoy", "roe_yoy", "equity_yoy",
        ),
    ),
    _table(
        "financial_shareholder_top10", ("ts_code", "end_date", "holder_name"), "end_date",
        text=("ts_code", "ann_date", "end_date", "holder_name", "holder_type"),
        number=("hold_amount", "hold_ratio", "hold_float_ratio", "hold_change"),
    ),
    _table(
        "financial_stock_holder", ("ts_code", "end_date"), "end_date",
        text=("ts_code", "ann_date", "end_date"),
        whole=("holder_num",),
    ),
    _table(
        "financial_top10_floatholders", ("ts_code", "ann_date", "end_date", "holder_name"), "end_date",
        text=("ts_code", "ann_date", "end_date", "holder_name", "holder_type"),
        number=("hold_amount", "hold_ratio", "hold_float_ratio", "hold_change"),
    ),
    _table(
        "index_basic", ("ts_code",), "ts_code",
        text=(
            "ts_code", "name", "fullname", "market", "publisher", "index_type", "category", "base_date", "list_date",
            "weight_rule", "desc", "exp_date",
        ),
        number=("base_point",),
    ),
    _table(
        "index_classify", ("index_code", "level", "src"), "index_code",
        text=("index_code", "industry_name", "level", "industry_code", "src", "is_pub", "parent_code"),
    ),
    _table(
        "index_daily", ("ts_code", "trade_date"), "trade_date",
        text=("ts_code", "trade_date"),
        number=("close", "open", "high", "low", "pre_close", "change", "pct_chg", "vol", "amount"),
    ),
    _table(
        "index_member_all", ("ts_code", "l1_code", "l2_code", "l3_code", "in_date"), "ts_code",
        text=(
            "l1_code", "l1_name", "l2_code", "l2_name", "l3_code", "l3_name", "ts_code", "name", "in_date", "out_date",
            "is_new",
        ),
    ),
    _table(
        "index_weight", ("index_code", "con_code", "trade_date"), "trade_date",
        text=("index_code", "con_code", "trade_date"),
        number=("weight",),
    ),
    _table(
        "kline_stock_factor", ("ts_code", "trade_date"), "trade_date",
        text=("ts_code", "trade_date"),
        number=(
            "macd_dif", "macd_dea", "macd", "kdj_k", "kdj_d", "kdj_j", "rsi_6", "rsi_12", "rsi_24", "boll_upper",
            "boll_mid", "boll_lower", "cci",
        ),
    ),
    _table(
        "market_daily_basic", ("ts_code", "trade_date"), "trade_date",
        text=("ts_code", "trade_date"),
        number=(
            "close", "turnover_rate", "turnover_rate_f", "volume_ratio", "pe", "pe_ttm", "pb", "ps", "ps_ttm",
            "dv_ratio", "dv_ttm", "total_share", "float_share", "free_share", "total_mv", "circ_mv",
        ),
    ),
    _table(
        "market_dividend", ("ts_code", "end_date", "div_proc"), "end_date",
        text=(
            "ts_code", "end_date", "ann_date", "div_proc", "record_date", "ex_date", "pay_date", "div_listdate",
            "imp_ann_date", "base_date",
        ),
        number=("stk_div", "stk_bo_rate", "stk_co_rate", "cash_div", "cash_div_tax", "base_share"),
    ),
    _table(
        "market_dragon_tiger_inst", ("ts_code", "trade_date", "exalter", "side"), "trade_date",
        text=("trade_date", "ts_code", "exalter", "side", "reason"),
        number=("buy", "buy_rate", "sell", "sell_rate", "net_buy"),
    ),
    _table(
        "market_dragon_tiger_list", ("ts_code", "trade_date"), "trade_date",
        text=("trade_date", "ts_code", "name", "reason"),
        number=(
            "close", "pct_change", "turnover_rate", "amount", "l_sell", "l_buy", "l_amount", "net_amount", "net_rate",
            "amount_rate", "float_value",
        ),
        renames=(("float_values", "float_value"),),
    ),
    _table(
        "market_hk_hold", ("trade_date", "ts_code", "exchange"), "trade_date",
        text=("code", "trade_date", "ts_code", "name", "exchange"),
        number=("ratio",),
        whole=("vol",),
    ),
    _table(
        "market_margin_detail", ("ts_code", "trade_date"), "trade_date",
        text=("trade_date", "ts_code"),
        number=("rzye", "rzmre", "rzche", "rzrqye", "rqye", "rqyl", "rqmcl", "rqchl"),
    ),
    _table(
        "market_moneyflow", ("ts_code", "trade_date"), "trade_date",
        text=("ts_code", "trade_date"),
        number=(
            "buy_sm_vol", "buy_sm_amount", "sell_sm_vol", "sell_sm_amount", "buy_md_vol", "buy_md_amount",
            "sell_md_vol", "sell_md_amount", "buy_lg_vol", "buy_lg_amount", "sell_lg_vol", "sell_lg_amount",
            "buy_elg_vol", "buy_elg_amount", "sell_elg_vol", "sell_elg_amount", "net_mf_vol", "net_mf_amount",
        ),
    ),
    _table(
        "market_moneyflow_hsgt", ("trade_date",), "trade_date",
        text=("trade_date",),
        number=("ggt_ss", "ggt_sz", "hgt", "sgt", "north_money", "south_money"),
    ),
    _table(
        "market_northbound_top10", ("ts_code", "trade_date", "market_type"), "trade_date",
        text=("trade_date", "ts_code", "name"),
        number=("close", "change", "amount", "net_amount", "buy", "sell"),
        whole=("rank", "market_type"),
    ),
    _table(
        "stock_active_count", ("date_key",), "date_key",
        text=("date_key",),
        whole=("listed_count", "trading_count"),
    ),
    _table(
        "stock_list", ("ts_code",), "ts_code",
        text=(
            "ts_code", "symbol", "name", "fullname", "enname", "cnspell", "market", "exchange", "curr_type",
            "list_status", "list_date", "delist_date", "is_hs", "is_ggt", "shenwan_1", "shenwan_2", "shenwan_3",
            "zhengjian_1", "zhengjian_2", "concept", "area", "city", "country",
        ),
        moment=(
            "kline_day_ddl", "kline_min_ddl", "report_income_ddl", "report_cashflow_ddl", "report_profit_ddl",
            "report_balance_ddl",
        ),
    ),
    _table(
        "stock_premarket", ("trade_date", "ts_code"), "trade_date",
        text=("trade_date", "ts_code"),
        number=("total_share", "float_share", "pre_close", "up_limit", "down_limit"),
    ),
    _table(
        "stock_share_float", ("ts_code", "float_date", "holder_name", "share_type"), "float_date",
        text=("ts_code", "ann_date", "float_date", "holder_name", "share_type"),
        number=("float_share", "float_ratio"),
    ),
    _table(
        "stock_suspend", ("ts_code", "trade_date", "suspend_type", "suspend_timing"), "trade_date",
        text=("ts_code", "trade_date", "suspend_timing", "suspend_type"),
        upper=("suspend_type",), allowed=(("suspend_type", ("S", "R")),),
    ),
    _table(
        "stock_trade_calendar", ("exchange", "cal_date"), "cal_date",
        text=("exchange", "cal_date", "is_open", "pretrade_date"),
        upper=("exchange",),
    ),
    _table(
        "kline_minute", ("ts_code", "trade_time"), "trade_time",
        text=("ts_code", "trade_time"),
        number=("open", "high", "low", "close", "pre_close", "change", "pct_chg", "vol", "amount"),
    ),
)

CONTRACTS = {c.name: c for c in (KLINE_DAILY, FACTOR, BLOCK_TRADE, REPORT_INCOME, SNAPSHOT, LOG_MISSING, *TABLES)}
