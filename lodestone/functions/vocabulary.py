"""Word lists of the query semantics."""

# Questions, sections and metrics are told apart by exactly these words.

STOPWORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "have", "in", "is", "it", "its", "of", "on", "or", "our", "the", "their", "this", "to", "was", "were", "with"]

NOISE_TOKENS = ["哪些", "什么", "怎么", "关于", "资料", "提到", "信息", "这份"]

ALIASES = {
    "宁德时代": ["CATL", "Contemporary Amperex Technology Co", "battery"],
    "比亚迪": ["BYD", "build your dreams", "battery"],
    "阳光电源": ["Sungrow", "inverter", "storage"],
    "隆基": ["LONGi", "LONGi Green Energy", "solar", "photovoltaic"],
    "隆基绿能": ["LONGi", "LONGi Green Energy", "solar", "photovoltaic"],
    "特斯拉": ["Tesla", "energy", "battery", "storage"],
    "第一太阳能": ["First Solar", "thin-film", "solar"],
    "国际能源署": ["IEA", "renewables", "energy"],
    "国际可再生能源署": ["IRENA", "renewables", "energy"],
    "储能": ["storage", "battery"],
    "光伏": ["solar", "photovoltaic"],
    "电池": ["battery", "cell", "cells"],
    "装机": ["capacity", "installed", "deployment"],
    "营收": ["revenue", "income", "sales"],
    "收入": ["revenue", "income", "sales"],
    "利润": ["profit", "earnings", "margin"],
    "财务": ["financial", "results"],
    "经营结果": ["financial", "results"],
    "产能": ["capacity", "manufacturing", "production"],
    "制造": ["manufacturing", "production"],
    "部署": ["deployment", "installed"],
    "订单": ["orders", "backlog", "deliveries"],
    "项目": ["project", "contract", "agreement"],
    "合作": ["partner", "cooperation", "agreement"],
    "海外": ["overseas", "international", "global"],
    "市场": ["market", "region", "international"],
    "技术路线": ["technology", "roadmap", "strategy"],
    "技术": ["technology", "product", "solution"],
    "解决方案": ["solution", "product"],
}

CATEGORY_KEYWORDS = {
    "financial": ["revenue", "income", "profit", "earnings", "margin", "financial", "收入", "营收", "利润", "财务", "经营结果"],
    "capacity": ["capacity", "manufacturing", "production", "installed", "deployment", "gw", "mwh", "产能", "装机", "制造", "部署"],
    "market": ["market", "region", "overseas", "international", "global", "country", "市场", "海外", "地区"],
    "technology": ["technology", "product", "solution", "platform", "roadmap", "r&d", "innov", "技术", "产品", "解决方案", "技术路线"],
    "project": ["project", "order", "contract", "agreement", "partner", "cooperation", "delivery", "项目", "订单", "合作"],
}

REWRITE_TERMS = {
    "financial": ["revenue", "net sales", "gross profit", "operating income", "net income", "financial review", "results of operations", "management discussion"],
    "capacity": ["capacity", "manufacturing capacity", "production", "deployment", "installed capacity", "operations"],
    "market": ["market", "region", "geographic", "international", "overseas", "segment"],
    "technology": ["technology", "product", "solution", "platform", "research and development", "roadmap"],
    "project": ["project", "order", "contract", "agreement", "delivery", "pipeline", "partner"],
}

RERANK_TERMS = {
    "financial": ["revenue", "net sales", "gross profit", "operating income", "net income", "results of operations", "financial review"],
    "capacity": ["capacity", "manufacturing", "production", "installed", "deployment", "gw", "mwh"],
    "market": ["market", "region", "geographic", "international", "overseas", "country", "segment"],
    "technology": ["technology", "product", "solution", "platform", "research", "development", "roadmap"],
    "project": ["project", "order", "contract", "agreement", "delivery", "pipeline", "partner"],
}

PREFERRED_SECTIONS = {
    "financial": [
        "financial review", "results of operations", "management discussion", "management discussion and analysis", "md&a", "mda", "financial statements",
        "财务报告", "管理层讨论与分析", "公司简介和主要财务指标", "主要财务指标", "财务报表", "财务报表附注", "经营业绩", "经营情况", "现金流量", "overview",
    ],
    "capacity": ["capacity", "manufacturing", "production", "operations"],
    "market": ["market", "region", "geographic", "segment"],
    "technology": ["technology", "product", "solution", "research", "development"],
    "project": ["project", "order", "contract", "delivery", "pipeline"],
}

NOISY_SECTIONS = ["notes to consolidated financial statements", "safe harbor", "forward-looking", "table of contents"]

METRIC_TERMS = [
    "主要财务指标", "营业收入", "净利润", "归属于上市公司股东的净利润", "扣除非经常性损益", "经营活动产生的现金流量净额", "现金流量净额", "资产总额", "净资产", "每股收益", "加权平均净资产收益率",
    "revenue", "net profit", "operating income", "cash flow", "net income",
]

FINANCIAL_SECTIONS = ["财务报告", "主要财务指标", "公司简介和主要财务指标", "财务报表", "财务报表附注"]

METRIC_LABELS = ["营业收入", "归属于上市公司股东的净利润", "归属于上市公司股东的扣除非经常性损益的净利润", "经营活动产生的现金流量净额", "资产总额", "净资产", "每股收益", "加权平均净资产收益率"]

DOCUMENT_HINTS = {
    "宁德时代": "catl", "catl": "catl", "比亚迪": "byd", "byd": "byd", "阳光电源": "sungrow", "sungrow": "sungrow", "隆基": "longi", "隆基绿能": "longi", "longi": "longi",
    "特斯拉": "tesla", "tesla": "tesla", "第一太阳能": "first solar", "first solar": "first solar", "iea": "iea", "国际能源署": "iea", "irena": "irena", "国际可再生能源署": "irena",
    "vestas": "vestas", "维斯塔斯": "vestas", "nordex": "nordex", "siemens gamesa": "siemens", "gamesa": "siemens",
}

COMPANY_ALIASES = {
    "tesla": "Tesla", "特斯拉": "Tesla", "catl": "CATL", "宁德时代": "CATL", "vestas": "Vestas", "longi": "LONGi", "隆基": "LONGi", "隆基绿能": "LONGi",
    "first solar": "First Solar", "sungrow": "Sungrow", "阳光电源": "Sungrow", "byd": "BYD", "比亚迪": "BYD",
}

METRIC_HINTS = [
    ("automotive revenue", "total automotive revenues"), ("total revenue", "total revenues"), ("revenue", "revenue"), ("营收", "revenue"), ("营业收入", "revenue"),
    ("net income", "net income"), ("净利润", "net income"), ("research and development", "research and development"), ("r&d", "research and development"),
    ("deliver", "vehicle deliveries"), ("交付", "vehicle deliveries"), ("shipment", "shipments"), ("出货", "shipments"),
]

ENTITY_TYPES = {
    "宁德时代": "company", "比亚迪": "company", "阳光电源": "company", "隆基绿能": "company", "Tesla": "company", "First Solar": "company", "Enphase": "company", "Vestas": "company", "Orsted": "company",
    "储能": "domain", "动力电池": "domain", "光伏": "domain", "风电": "domain", "逆变器": "product", "储能系统": "product", "光伏组件": "product", "电动车": "domain",
}

RELATION_HINTS = [
    ("包括", "includes"), ("覆盖", "covers"), ("属于", "belongs_to"), ("相关", "related_to"), ("布局", "invests_in"),
    ("生产", "produces"), ("研发", "develops"), ("专注", "focuses_on"), ("对标", "benchmarks"), ("合作", "partners_with"),
]

SEED_SUBJECTS = {"CATL": "宁德时代", "BYD": "比亚迪", "Sungrow": "阳光电源", "LONGi": "隆基绿能", "Tesla": "特斯拉", "First Solar": "First Solar", "IEA": "IEA", "IRENA": "IRENA"}

SEED_KEYWORDS = {
    "financial": ["revenue", "income", "profit", "earnings", "margin", "financial"],
    "capacity": ["capacity", "manufacturing", "production", "installed", "deployment", "gw", "mwh"],
    "market": ["market", "region", "overseas", "international", "global", "country"],
    "technology": ["technology", "product", "solution", "platform", "roadmap", "r&d", "innov"],
    "project": ["project", "order", "contract", "agreement", "partner", "cooperation", "delivery"],
}

SEED_PATTERNS = {
    "financial": ["这份资料里关于{subject}的营收/收入怎么说？", "{subject} 在资料里提到的财务表现是什么？", "{subject} 的收入、利润或经营结果有哪些信息？"],
    "capacity": ["{subject} 的产能或装机信息是什么？", "这份资料提到的 {subject} 产能扩张有哪些内容？", "{subject} 在产能、制造或部署上有哪些进展？"],
    "market": ["{subject} 的海外市场或地区布局是什么？", "{subject} 在哪些市场有业务或项目？", "这份资料里 {subject} 的市场分布怎么写？"],
    "technology": ["{subject} 的技术路线或产品方案是什么？", "资料中 {subject} 提到哪些技术、产品或解决方案？", "{subject} 有哪些技术升级或路线变化？"],
    "project": ["{subject} 的项目、订单或合作内容是什么？", "这份资料提到 {subject} 哪些项目进展？", "{subject} 相关的合作方和项目情况有哪些？"],
}

PRONOUNS = ["它", "该公司", "这家公司", "its", "their", "the company", "they"]

INTENT_AGENTS = {"financial": "financial_agent", "comparison": "comparison_agent", "summary": "summary_agent", "technical": "react_planner", "market": "react_planner", "complex": "react_planner", "general": "react_planner"}

NOISE_PATTERNS = [
    "forward-looking statements?", "safe harbor", "all rights reserved", "copyright", "investor relations", "annual report", "interim report", "website", r"www\.", "https?://",
    "for more information", "this document is for informational purposes", "no representation or warranty", "the company shall not be liable",
]

HEADING_TERMS = [
    "管理层讨论与分析", "管理层讨论", "董事会报告", "董事会工作报告", "财务报表", "财务报表附注", "财务状况", "经营情况", "经营业绩", "主要会计政策", "公司概况", "风险因素", "股东信息", "重大事项", "审计报告",
]

BLOCK_TAGS = ["article", "aside", "blockquote", "br", "div", "footer", "h1", "h2", "h3", "h4", "h5", "h6", "header", "li", "p", "section", "table", "tr"]
