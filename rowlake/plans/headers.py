"""Header names mapped to the fields that they stand for: exactly, by a part, or, in mode auto, by likeness and by the values below them.

Runs on the driver over column names; a sample of at most SAMPLE values a column is all that it sees of the data.
"""

from __future__ import annotations

import re
import unicodedata

SAMPLE = 10

#: The names that headers use for a field.
ALIASES = {
    "id": ["id", "record_id", "row_id", "identifier", "编号", "序号", "单号", "记录编号"],
    "amount": ["amount", "amt", "total_amount", "金额", "总金额", "发生额", "本期金额", "收款金额", "付款金额", "金额（万元）", "金额(万元)"],
    "currency": ["currency", "ccy", "币种", "货币", "结算币种"],
    "biz_date": ["biz_date", "date", "transaction_date", "业务日期", "发生日期", "交易日期", "记账日期", "入账日期"],
    "published_at": ["published_at", "publish_date", "published_date", "pub dt", "pub_dt", "发布日期", "发布时间", "发表时间"],
    "account_no": ["account_no", "account", "账号", "账户", "账户号", "卡号"],
    "txn_date": ["txn_date", "transaction_date", "posting_date", "交易日期", "记账日期", "入账日期", "日期"],
    "debit_amount": ["debit_amount", "debit", "out_amount", "借方金额", "支出", "付款金额"],
    "credit_amount": ["credit_amount", "credit", "in_amount", "贷方金额", "收入", "收款金额"],
    "balance": ["balance", "余额", "账户余额"],
    "counterparty_name": ["counterparty_name", "counterparty", "cp", "对方户名", "对手方", "交易对手"],
    "remark": ["remark", "memo", "摘要", "附言", "备注", "用途"],
    "ref_no": ["ref_no", "reference_no", "ref no", "流水号", "交易流水号", "凭证号"],
    "txn_type": ["txn_type", "transaction_type", "交易类型", "业务类型", "方向", "借贷方向", "借贷标志", "收支方向"],
    "customer_name": ["customer_name", "customer", "name", "客户", "客户名称", "姓名", "联系人", "联系人姓名"],
    "phone": ["phone", "mobile", "tel", "telephone", "手机号", "手机", "电话号码", "联系电话", "座机"],
    "city": ["city", "city_name", "city name", "城市", "所在城市"],
    "claim_text": ["claim_text", "text", "content", "claim", "正文", "内容", "文本", "观点", "论点", "主张"],
    "source_url": ["source_url", "url", "link", "src url", "链接", "网址", "来源链接", "来源网址", "原文链接"],
    "source_title": ["source_title", "title", "src title", "标题", "来源标题", "文章标题", "文档标题"],
    "speaker": ["speaker", "author", "speaker name", "作者", "发言人", "说话人", "发布者"],
    "speaker_role": ["speaker_role", "speaker type", "speaker_type", "发言角色"],
    "argument_role": ["argument_role", "claim_type", "argument type", "论证角色"],
    "source_domain": ["source_domain", "domain", "host", "来源域名"],
    "citation_text": ["citation_text", "citation", "ref_text", "引用"],
    "quote_text": ["quote_text", "quote", "quoted_text", "引文正文"],
    "debate_topic": ["debate_topic", "topic", "议题", "主题"],
    "language": ["language", "lang", "语言"],
    "stance": ["stance", "立场", "态度"],
    "confidence": ["confidence", "可信度", "置信度"],
}


def token(text: str | None) -> str:
    """A header's plain form: NFKC, lower case, letters, digits and CJK joined by single underscores."""
    text = re.sub(r"[\s\-/:]+", "_", unicodedata.normalize("NFKC", text or "").strip().lower())
    return re.sub(r"_+", "_", re.sub(r"[^0-9a-z_一-鿿]+", "", text)).strip("_")


def likeness(a: str, b: str) -> float:
    """0 to 100: twice the longest common subsequence over both lengths."""
    if not a and not b:
        return 100.0
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return 200.0 * row[-1] / (len(a) + len(b))


def _sorted_words(a: str, b: str) -> float:
    return likeness(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def _word_sets(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    one, two = (" ".join([*([both] if both else []), *sorted(z)]) for z in (x - y, y - x))
    if both and (not x - y or not y - x):
        return 100.0
    return max(likeness(one, two), *((likeness(both, one), likeness(both, two)) if both else (0.0,)))


def _best_part(a: str, b: str) -> float:
    a, b = sorted((a, b), key=len)
    return max((likeness(a, b[i : i + len(a)]) for i in range(max(1, len(b) - len(a) + 1))), default=0.0) if a else 0.0


def _affinity(kinds: dict, field: str, values: list) -> float:
    """5 points where most of the sampled values are numbers of a number field, or dates of a date field."""
    some = [str(v).strip() for v in values if v is not None and str(v).strip()][:SAMPLE]
    pattern = r"[(（]?[-+¥￥$€£]?\s*[\d,]*\.?\d+\s*[)）万亿元-]?" if field in kinds.get("numeric", ()) else r"\d{4}[-/.年]\d{1,2}[-/.月]\d{1,2}日?(?:[ T].*)?|\d{8}" if field in kinds.get("date", ()) else None
    return 5.0 if pattern and some and sum(bool(re.fullmatch(pattern, v)) for v in some) >= 0.7 * len(some) else 0.0


def map_header(name: str, mode: str = "strict", profile: dict | None = None, values: list = (), aliases: dict[str, list[str]] | None = None) -> dict:
    """field (or None), confidence, strategy (exact, substring, fuzzy, fuzzy+value_affinity, unresolved) and alternatives.

    strict takes the first field of several; auto leaves a header that several fields fit unresolved, and tries likeness:
    0.5 word sets + 0.3 sorted words + 0.2 best part, 6 points for an alias, 4 for a required field, 5 for fitting values;
    a field needs 82 points, and 6 more than the next.
    """
    mine, known = token(name), {f: [token(x) for x in [f, *names]] for f, names in (ALIASES | (aliases or {})).items()}
    unresolved = lambda c, others=(): {"field": None, "confidence": c, "strategy": "unresolved", "alternatives": list(others)[:3]}
    if not mine:
        return unresolved(0.0)

    def found(fields: list[str], confidence: float, strategy: str) -> dict:
        fields = list(dict.fromkeys(fields))
        if mode == "auto" and len(fields) > 1:
            return unresolved(0.55, ((f, confidence) for f in fields))
        return {"field": fields[0], "confidence": confidence, "strategy": strategy, "alternatives": [(fields[0], confidence)]}

    if exact := [f for f, names in known.items() if mine in names]:
        return found(exact, 1.0, "exact")
    parts = sorted(((-len(x), x, f) for f, names in known.items() for x in names if x in mine and (len(x) > 1 or x in ("id", "url"))))
    if parts:
        return found([f for *_, f in parts], 0.88, "substring")
    if mode != "auto":
        return unresolved(0.55)
    left, scores = mine.replace("_", " "), {}
    for f, names in known.items():
        bonus = _affinity(profile or {}, f, list(values))
        for x in filter(None, names):
            right = x.replace("_", " ")
            score = 0.5 * _word_sets(left, right) + 0.3 * _sorted_words(left, right) + 0.2 * _best_part(left, right)
            score = min(100.0, score + (6 if x != token(f) else 0) + (4 if f in (profile or {}).get("required", ()) else 0) + bonus)
            if score > scores.get(f, (0.0, ""))[0]:
                scores[f] = score, "fuzzy+value_affinity" if bonus else "fuzzy"
    best = sorted(((-s, f, how) for f, (s, how) in scores.items()))
    others = [(f, round(-s / 100, 6)) for s, f, _ in best]
    if best and -best[0][0] >= 82 and (len(best) == 1 or best[1][0] - best[0][0] >= 6):
        return {"field": best[0][1], "confidence": others[0][1], "strategy": best[0][2], "alternatives": others[:3]}
    return unresolved(0.55, others)
