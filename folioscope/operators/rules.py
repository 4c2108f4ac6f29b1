"""One rule scorer for topic families, content splits and child topics.

Rules are data: a list of Rule, from code or from a JSON-lines file (load_rules). The scorer is one expression over the row's
texts, without a join. For a few words it looks for each by itself; for many, matcher.py finds all of them in one pass. Of equal scores the rule declared first wins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, fields

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text as t
from folioscope.functions.lexicons import GENERIC_EVIDENCE
from folioscope.operators import matcher


@dataclass(frozen=True)
class Rule:
    name: str
    title_words: tuple[str, ...] = ()
    body_words: tuple[str, ...] = ()
    prior_words: tuple[str, ...] | None = None  # title and body words where not given
    title_weight: float = 1.0
    body_weight: float = 1.0
    prior_weight: float = 0.0
    boost: float = 1.0
    patterns: tuple[str, ...] = ()  # each found in the title adds 2
    needs_content: bool = False  # a hit in title or body, or the latin bonus
    latin_bonus: float = 0.0  # adds 2 from this share of Latin letters on
    generic: tuple[str, ...] = ()  # some hit in title or body must be none of these
    evidence: tuple[int, int, int] = (5, 5, 4)


def score_rule(rule: Rule, low: Column, found: Column | None = None) -> Column:
    """struct<score double, name string, evidence array<string>>; null where the rule doesn't apply. low: struct of title, body and prior in lower case, the raw title, and latin.
    found: what matcher.match_rules has for the rule; without it, each word is looked for by itself."""
    if found is not None:
        na, nb, nc, told, specific = (found[c] for c in ("a", "b", "c", "told", "specific"))
    else:
        parts = list(zip((low["title"], low["body"], low["prior"]), matcher.words_of(rule), strict=True))
        a, b, c = (t.contained(x, w, True, True) for x, w in parts)
        na, nb, nc = (t.hits(x, w, True, True) for x, w in parts)
        told = F.array_union(F.array_union(F.slice(a, 1, rule.evidence[0]), F.slice(b, 1, rule.evidence[1])), F.slice(c, 1, rule.evidence[2]))
        specific = F.size(F.array_except(F.array_union(a, b), F.array(*map(F.lit, rule.generic)))) > 0
    score = na * F.lit(rule.title_weight) + nb * F.lit(rule.body_weight) + nc * F.lit(rule.prior_weight)
    for p in rule.patterns:
        found = low["raw"].rlike(f"(?iu){p}")
        score = score + F.when(found, 2.0).otherwise(0.0)
        told = F.when(found, F.array_append(told, F.lit(p))).otherwise(told)
    applies = F.lit(True)
    bonus = (low["latin"] >= rule.latin_bonus) if rule.latin_bonus else F.lit(False)
    if rule.latin_bonus:
        score = score + F.when(bonus, 2.0).otherwise(0.0)
        told = F.when(bonus, F.array_append(told, F.lit(f"latin_ratio>={rule.latin_bonus:.2f}"))).otherwise(told)
    if rule.needs_content:
        applies = (na + nb > 0) | bonus
    if rule.generic:
        applies = applies & specific
    made = t.let(F.round(score * rule.boost, 6), lambda s: F.when(s > 0, F.struct(s.alias("score"), F.lit(rule.name).alias("name"), F.slice(told, 1, 8).alias("evidence"))))
    return F.when(applies, made)


def ranked(rules: Sequence[Rule], title: Column, body: Column, prior: Column, latin: Column | None = None, found: Column | None = None) -> Column:
    """The rules that apply, best first. Texts are put in lower case once for all rules. found: a column of matcher.match_rules over the same rules and texts."""
    if not rules:
        return F.array().cast("array<struct<score:double,name:string,evidence:array<string>>>")
    low = F.struct(F.lower(title).alias("title"), F.lower(body).alias("body"), F.lower(prior).alias("prior"), title.alias("raw"), (latin if latin is not None else F.lit(0.0)).alias("latin"))

    def order(z: Column) -> Column:
        placed = F.transform(F.array(*(score_rule(r, z, None if found is None else F.get(found, F.lit(k))) for k, r in enumerate(rules))), lambda x, i: F.struct((-x["score"]).alias("low"), i.alias("i"), x.alias("rule")))
        return F.transform(F.array_sort(F.filter(placed, lambda x: x["rule"].isNotNull())), lambda x: x["rule"])

    return t.let(low, order)


def family(rules: Sequence[Rule], overrides: Mapping[str, tuple[str, str]], fallback: str, raw_name: Column, text: Column) -> Column:
    """struct<name, confidence, evidence, candidates>: an exact override (confidence 1), else the best rule with its share of all scores, else the fallback at 0.1."""

    def choose(order: Column) -> Column:
        total = F.aggregate(order, F.lit(0.0), lambda s, x: s + x["score"])
        best = F.try_element_at(order, F.lit(1))
        made = F.struct(best["name"].alias("name"), (best["score"] / total).alias("confidence"), F.array_join(best["evidence"], "、").alias("evidence"), F.slice(order, 1, 4).alias("candidates"))
        return F.when(F.size(order) > 0, made).otherwise(F.struct(F.lit(fallback).alias("name"), F.lit(0.1).alias("confidence"), F.lit("fallback").alias("evidence"), F.slice(order, 1, 4).alias("candidates")))

    out = t.let(ranked(rules, text, F.lit(""), F.lit("")), choose)
    for raw, (name, why) in overrides.items():
        own = F.struct(F.lit(name).alias("name"), F.lit(1.0).alias("confidence"), F.lit(why).alias("evidence"), F.array(F.struct(F.lit(10.0).alias("score"), F.lit(name).alias("name"), F.array(F.lit(why)).alias("evidence"))).alias("candidates"))
        out = F.when(raw_name == F.lit(raw), own).otherwise(out)
    return out


def domain_override(domains: Sequence[tuple[str, Sequence[str], int]], title: Column) -> Column:
    """struct<name, reason> of the first domain with enough words in the title; null if none."""
    made = []
    for name, words, least in domains:
        found = t.contained(title, words, True)
        made.append(F.when(t.hits(title, words, True) >= least, F.struct(F.lit(name).alias("name"), F.concat(F.lit("domain_override:"), F.array_join(F.slice(found, 1, 6), "、")).alias("reason"))))
    return F.coalesce(*made) if made else F.lit(None).cast("struct<name:string,reason:string>")


def content_split(rules: Sequence[Rule], domains: Sequence[tuple[str, Sequence[str], int]], overridden: str, fallback: str, title: Column, body: Column, prior: Column, found: Column | None = None) -> Column:
    """struct<name, reason> of a document by its content; the rule named ``overridden`` gives way to a domain that the title names. found: as in ranked."""
    latin = t.latin_ratio(t.join_nonempty(" ", title, body, prior))

    def choose(best: Column) -> Column:
        own = F.when(best.isNotNull(), F.struct(best["name"].alias("name"), F.coalesce(F.nullif(F.array_join(best["evidence"], "、"), F.lit("")), F.lit("content_keyword_match")).alias("reason")))
        other = F.when(best["name"] == overridden, domain_override(domains, title))
        return F.coalesce(other, own, F.struct(F.lit(fallback).alias("name"), F.lit("content_fallback").alias("reason")))

    return t.let(F.try_element_at(ranked(rules, title, body, prior, latin, found), F.lit(1)), choose)


def child_label(rules: Mapping[str, Sequence[Rule]], fallbacks: Mapping[str, str], parent: Column, reason: Column, title: Column, body: Column, found: Column | None = None) -> Column:
    """struct<name, reason>: the best child rule of the document's parent topic, else the parent's fallback name. found: a column of match_children."""
    prior = child_prior(parent, reason)
    name = F.concat(parent, F.lit("综合类"))
    for p, f in fallbacks.items():
        name = F.when(parent == p, F.lit(f)).otherwise(name)
    out = F.struct(name.alias("name"), F.coalesce(F.nullif(reason, F.lit("")), F.lit("subtopic_fallback")).alias("reason"))
    begin = 0
    for p, own in rules.items():
        matched = None if found is None else F.slice(found, begin + 1, len(own))
        begin += len(own)
        best = F.when(parent == p, t.let(F.try_element_at(ranked(own, title, body, prior, found=matched), F.lit(1)), lambda b: F.when(b.isNotNull(), F.struct(b["name"].alias("name"), F.array_join(b["evidence"], "、").alias("reason")))))
        out = F.coalesce(best, out)
    return out


def child_prior(parent: Column, reason: Column) -> Column:
    return F.concat(parent, F.lit(" "), reason)


def match_children(rules: Mapping[str, Sequence[Rule]], parent: Column, reason: Column, title: Column, body: Column) -> Column:
    """What matcher.match_rules finds for the rules of all parents, one after the other."""
    return matcher.match_rules([r for own in rules.values() for r in own], title, body, child_prior(parent, reason))


def child_rule(name: str, words: Sequence[str], patterns: Sequence[str] = (), boost: float = 1.0) -> Rule:
    return Rule(name, tuple(words), tuple(words), tuple(words), 2.2, 1.0, 0.4, boost, tuple(patterns), evidence=(4, 4, 3))


def specific_evidence(reason: Column, generic: Sequence[str] = GENERIC_EVIDENCE, strict: bool = False) -> Column:
    """Whether some piece of a split reason is more than a generic word. Pieces are separated by 、 only, so a reason made of two parts nearly always is;
    strict also separates at '; ' and leaves out fallbacks."""
    bare = F.replace(F.coalesce(reason, F.lit("")), F.lit("domain_override:"), F.lit(""))
    pieces = F.filter(F.transform(F.split(bare, "、|; " if strict else "、"), t.strip), lambda x: x != "")
    out = [*generic, "content_fallback", "subtopic_fallback"] if strict else list(generic)
    found = F.exists(pieces, lambda x: ~x.isin(*out) & ~F.startswith(x, F.lit("latin_ratio")))
    return F.when(F.coalesce(reason, F.lit("")).isin("", "content_fallback"), False).otherwise(found)


def load_rules(spark: SparkSession, path: str) -> list[Rule]:
    """Rules from a JSON-lines file whose keys are Rule's fields; order in the file (column ``ord``, else as read) is declaration order."""
    rows = spark.read.json(path)
    rows = rows.orderBy("ord") if "ord" in rows.columns else rows
    known = {f.name for f in fields(Rule)}
    return [Rule(**{k: tuple(v) if isinstance(v, list) else v for k, v in r.asDict().items() if k in known and v is not None}) for r in rows.collect()]


# The thirteen topic families with their words and boosts, and the raw names that decide by themselves.
FAMILIES = [
    Rule("企业投资与房地产类", ("企业", "投资", "固定资产", "房地产", "开发", "资产", "建筑业", "施工", "利润", "成本", "营业"), boost=1.5),
    Rule("地区民生与收入消费类", ("地区", "居民", "收入", "消费", "旅游", "零售", "生活", "服务", "客运", "冰雪"), boost=1.4),
    Rule("教育科研与学术文献类", ("教育", "学校", "大学", "学院", "高校", "学生", "教师", "科研", "研究", "论文", "学报", "期刊", "课题"), boost=1.5, patterns=(r"\b(Abstract|Keywords|References|Journal|Paper|Thesis)\b",)),
    Rule("工业交通与能源通信类", ("工业", "交通", "运输", "客运", "货运", "铁路", "公路", "港口", "邮政", "通信", "电信", "能源", "电力", "煤炭", "石油", "物流"), boost=1.4),
    Rule("资源环境与城市建设类", ("耕地", "土地", "水利", "生态", "环境", "城市", "地震", "气象", "基础设施", "供水", "排水", "绿化", "监测"), boost=1.4),
    Rule("财政金融与宏观经济类", ("生产总值", "国内生产总值", "财政", "金融", "预算", "决算", "税收", "货币", "贷款", "存款", "外债", "证券", "股票", "债券", "价格", "指数", "收入", "支出"), boost=1.5),
    Rule("人口就业与社会保障类", ("人口", "就业", "失业", "年龄", "出生", "死亡", "抚养比", "社保", "社会保障", "民政", "养老", "社会事业"), boost=1.4),
    Rule("农业农村与土地资源类", ("农业", "农村", "农民", "粮食", "耕地", "农作物", "牲畜", "畜牧", "乡村", "水稻", "播种"), boost=1.4),
    Rule("科技专利与标准规范类", ("科技", "技术", "专利", "发明", "实用新型", "外观设计", "知识产权", "标准", "规范", "规程", "检验", "检测", "认证", "质量", "指南"), boost=1.4),
    Rule("医药卫生与药品类", ("卫生", "医疗", "医院", "诊疗", "门诊", "床位", "医药", "药品", "药学", "处方", "医学", "健康", "疾病", "药物"), boost=1.4),
    Rule("文化旅游与居民消费类", ("文化", "旅游", "游客", "景区", "冰雪", "消费", "零售", "商品", "服务业", "餐饮", "住宿", "体育", "娱乐", "休闲"), boost=1.4),
    Rule("综合统计指标类", ("单位", "人员", "平均", "情况", "编号", "时间", "指标", "统计", "数据", "合计", "数量", "总计", "表"), boost=1.4),
    Rule("对外贸易与国际经济类", ("进出口", "出口", "进口", "外贸", "外资", "外汇", "国际旅游", "贸易", "海关", "口岸", "利用外资", "跨境"), boost=1.4),
]
FAMILY_OVERRIDES = {
    "单位、人员、平均类": ("单位人员与平均指标类", "raw_topic_override:单位/人员/平均"),
    "情况、编号、时间类": ("基础情况与时序记录类", "raw_topic_override:情况/编号/时间"),
    "编号、时间、情况类": ("基础统计表格类", "raw_topic_override:编号/时间/情况"),
    "企业、编号、时间类": ("企业统计与经营情况类", "raw_topic_override:企业/编号/时间"),
}
FAMILY_FALLBACK = "综合统计指标类"

# The ten domains that a title names by two words or more, in the order in which they are tried, and the names of the content split.
DOMAINS = [
    ("财政金融与宏观经济类", ("生产总值", "国内生产总值", "国民经济", "财政", "预算", "决算", "金融", "税收", "贷款", "存款", "证券", "价格", "财政收入", "财政支出", "公共预算"), 2),
    ("企业投资与房地产类", ("企业", "投资", "固定资产", "房地产", "市场主体", "建设项目", "开发区", "招商", "营商", "产业链", "供应链"), 2),
    ("工业交通与能源通信类", ("工业", "交通", "运输", "铁路", "公路", "港口", "物流", "邮政", "通信", "电信", "能源", "电力", "煤炭", "石油", "燃气"), 2),
    ("人口就业与社会保障类", ("人口", "就业", "失业", "民生", "社保", "养老", "居民收入", "医疗保障", "社会保障", "住房保障", "脱贫", "扶贫", "疫情", "健康"), 2),
    ("资源环境与城市建设类", ("生态", "环境", "环保", "污染", "城市", "基础设施", "水利", "供水", "排水", "绿化", "地震", "气象", "碳达峰", "碳中和"), 2),
    ("农业农村与土地资源类", ("农业", "农村", "农民", "粮食", "耕地", "土地", "农作物", "畜牧", "乡村", "扶贫", "脱贫"), 2),
    ("科技专利与标准规范类", ("科技", "创新", "专利", "技术", "研发", "标准", "规范", "知识产权", "数字技术", "人工智能"), 2),
    ("文化旅游与居民消费类", ("文化", "旅游", "游客", "景区", "消费", "零售", "餐饮", "住宿", "体育", "娱乐", "服务业", "休闲"), 2),
    ("医药卫生与药品类", ("卫生", "医疗", "医院", "诊疗", "药品", "医药", "药学", "疾病", "疫情防控", "核酸"), 2),
    ("教育科研与学术文献类", ("教育", "学校", "大学", "学院", "学生", "教师", "科研", "论文", "课题", "学术"), 2),
]
SPLIT_FALLBACK, OVERRIDDEN = "综合内容待判别类", "政府治理与公共管理类"
# End of fixed values.
