"""Word lists of the governance rules. All operators take lexicons as parameters; these are the defaults."""

from __future__ import annotations

# Results depend on these words.
POLICY = ("通知", "办法", "细则", "方案", "意见", "规定", "条例", "公告", "要求", "实施", "管理", "文件")
MONEY = ("资金", "财政", "经费", "预算", "补贴", "拨付", "结算", "报销", "奖补", "资助", "贷款", "支付", "扶持", "分配")
TIME = ("紧急", "立即", "尽快", "及时", "期限", "截止", "月底", "今日", "明日", "本周", "本月", "近日", "时限")
REVIEW = ("复核", "审核", "审查", "复审", "核验", "校验", "检查", "核对", "人工", "质检")
APPROVAL = ("审批", "核准", "批准", "报批", "备案", "签批", "发文", "批复", "审定")
BUSINESS = ("项目", "合同", "会议", "培训", "考核", "统计", "报表", "台账", "清单", "名单", "汇总", "记录", "采购", "申报", "申請")
TEMPLATE_HINTS = ("首页", "登录", "注册", "搜索", "栏目", "专题", "互动", "服务", "公开", "版权所有", "联系方式", "站内搜索", "信息公开", "友情链接", "网站地图")
META_PREFIXES = ("发布者", "发布时间", "来源", "作者", "记者", "通讯员", "原文链接", "网址", "URL", "地址", "电话", "邮箱", "传真")
URGENCY = ("紧急", "立即", "尽快", "限期", "截止", "时限", "今日", "明日", "本周", "本月", "近期", "加急", "urgent", "deadline")
NECESSITY = ("资金", "财政", "经费", "预算", "决算", "拨付", "报销", "补贴", "资助", "审计", "审批", "核准", "备案", "合同", "招标", "采购", "质量", "标准", "药品", "专利")
GENERIC_EVIDENCE = ("教育", "科研", "研究", "项目", "工作", "问题", "材料", "发展", "content_keyword_match")
#: A character of lines that have nothing but marks, digits and Latin letters.
MARKS_ONLY = r"[\s·|/\\\-_=—…\.\dA-Za-z]"
# End of fixed values.

FEATURES = {"policy": POLICY, "money": MONEY, "time": TIME, "review": REVIEW, "approval": APPROVAL, "business": BUSINESS}

#: The same shape over Latin words, for tables without Han text.
LATIN_FEATURES = {
    "policy": ("the", "and", "der", "para"), "money": ("tion", "ment", "keit"), "time": ("ing", "heit", "pour"),
    "review": ("ered", "chen", "mente"), "approval": ("onth", "ciónes", "aux"), "business": ("ofthe", "undder", "with"),
}
LATIN_HINTS = ("License", "Copyright", "mail", "com", "www", "tel")
LATIN_URGENCY = ("thea", "verb", "que", "inst", "deadline", "urgent")
LATIN_NECESSITY = ("ation", "keit", "ción", "ment", "ther", "schein", "reon")
