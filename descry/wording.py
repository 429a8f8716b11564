"""Report wording in four languages.

Fixed values: every text below is part of the results (sentences, table labels, role notes, banned terms) and
therefore stands here word for word. Placeholders in braces are filled by ``functions.text.fill_template``.
"""

LANGUAGES = ("en", "zh-CN", "es", "fi")
ROLES = ("identifier", "numeric", "categorical", "ordinal", "date", "text")
REPORT_TYPES = ("automatic", "descriptive", "data_quality", "group", "relationships", "change", "time")
CHART_BUDGETS = {"brief": 3, "standard": 5, "detailed": 8}

NOTE_OVERRIDE = "User override applied."
NOTE_ORDINAL = "Low-cardinality integer scale; confirm order before ordered analysis."
NOTE_DATE = "Unambiguous date-like strings; confirm role if needed."

#: Sentence templates by language and kind.
SENTENCES = {
    "en": {
        "dataset": "The dataset contains {rows} records and {columns} variables.",
        "missing": "{label} has {missing} originally missing values ({percent}% of all records).",
        "numeric": "For {label}, finite valid observations numbered {n}; M = {mean}, SD = {sd}, median = {median}, minimum = {minimum}, and maximum = {maximum}.",
        "range_finding": "{label}: {count} finite values fall outside the user-supplied range {minimum} to {maximum}; values were flagged, not removed.",
        "effect": "Using first-observed order ({direction}), the mean difference was {difference} and pooled-SD Cohen's d was {effect}.",
        "effect_unavailable": "Cohen's d requires two explicitly confirmed independent groups.",
        "relationship": "Pearson r for {first} and {second} used {n} pairwise-complete finite observations and was {r}; it describes linear association only.",
        "relationship_unavailable": "Pearson r was unavailable ({reason}); pairwise n = {n}.",
        "change": "On the identical {n} complete pairs, post minus pre change had M = {mean}, SD = {sd}, and median = {median}; direction was not interpreted as improvement.",
        "time": "The date-level series used {n} finite observations; duplicate dates were aggregated by mean and no interpolation was applied.",
        "direction": "{first} minus {second}",
    },
    "zh-CN": {
        "dataset": "该数据集包含 {rows} 条记录和 {columns} 个变量。",
        "missing": "变量“{label}”有 {missing} 个原始缺失值（占全部记录的 {percent}%）。",
        "numeric": "变量“{label}”共有 {n} 个有限有效观测；M = {mean}，SD = {sd}，中位数 = {median}，最小值 = {minimum}，最大值 = {maximum}。",
        "range_finding": "{label}：有 {count} 个有限值超出用户指定范围 {minimum} 至 {maximum}；这些值仅被标记，未被删除。",
        "effect": "按首次出现顺序（{direction}），均值差为 {difference}，合并标准差 Cohen's d 为 {effect}。",
        "effect_unavailable": "仅在明确确认两个组相互独立时计算 Cohen's d。",
        "relationship": "{first} 与 {second} 的 Pearson r 使用 {n} 个成对完整的有限观测，结果为 {r}；该结果仅描述线性关联。",
        "relationship_unavailable": "无法计算 Pearson r（{reason}）；成对样本量 n = {n}。",
        "change": "在相同的 {n} 个完整配对中，后测减前测的变化为 M = {mean}、SD = {sd}、中位数 = {median}；未将变化方向解释为改善。",
        "time": "日期序列使用 {n} 个有限观测；同日记录按均值聚合，未进行插值。",
        "direction": "{first} minus {second}",
    },
    "es": {
        "dataset": "El conjunto contiene {rows} registros y {columns} variables.",
        "missing": "{label} tiene {missing} valores originalmente faltantes ({percent}% de todos los registros).",
        "numeric": "Para {label} hubo {n} observaciones válidas finitas; M = {mean}, DE = {sd}, mediana = {median}, mínimo = {minimum} y máximo = {maximum}.",
        "range_finding": "{label}: {count} valores finitos están fuera del rango indicado por el usuario, de {minimum} a {maximum}; se marcaron, no se eliminaron.",
        "effect": "Según el orden de primera aparición ({direction}), la diferencia de medias fue {difference} y la d de Cohen con DE combinada fue {effect}.",
        "effect_unavailable": "La d de Cohen requiere dos grupos independientes confirmados explícitamente.",
        "relationship": "La r de Pearson entre {first} y {second} usó {n} pares completos finitos y fue {r}; solo describe asociación lineal.",
        "relationship_unavailable": "No se pudo calcular la r de Pearson ({reason}); n por pares = {n}.",
        "change": "En los mismos {n} pares completos, el cambio post menos pre tuvo M = {mean}, DE = {sd} y mediana = {median}; la dirección no se interpretó como mejora.",
        "time": "La serie por fecha usó {n} observaciones finitas; las fechas repetidas se agregaron mediante la media, sin interpolación.",
        "direction": "{first} minus {second}",
    },
    "fi": {
        "dataset": "Aineistossa on {rows} havaintoa ja {columns} muuttujaa.",
        "missing": "Muuttujasta {label} puuttuu alun perin {missing} arvoa ({percent}% kaikista havainnoista).",
        "numeric": "Muuttujalla {label} oli {n} äärellistä kelvollista havaintoa; KA = {mean}, KH = {sd}, mediaani = {median}, minimi = {minimum} ja maksimi = {maximum}.",
        "range_finding": "{label}: {count} äärellistä arvoa on käyttäjän ilmoittaman vaihteluvälin {minimum}–{maximum} ulkopuolella; arvot merkittiin, niitä ei poistettu.",
        "effect": "Ensimmäisen esiintymisen järjestyksessä ({direction}) keskiarvojen ero oli {difference} ja yhdistettyyn keskihajontaan perustuva Cohenin d oli {effect}.",
        "effect_unavailable": "Cohenin d edellyttää kahta nimenomaisesti riippumattomiksi vahvistettua ryhmää.",
        "relationship": "Muuttujien {first} ja {second} Pearsonin r perustui {n} parittaiseen äärelliseen havaintoon ja oli {r}; se kuvaa vain lineaarista yhteyttä.",
        "relationship_unavailable": "Pearsonin r ei ollut laskettavissa ({reason}); parittainen n = {n}.",
        "change": "Samoissa {n} täydellisessä havaintoparissa loppu- ja alkumittauksen erotuksen KA = {mean}, KH = {sd} ja mediaani = {median}; suuntaa ei tulkittu paranemiseksi.",
        "time": "Päivätason sarja käytti {n} äärellistä havaintoa; samojen päivien havainnot yhdistettiin keskiarvolla ilman interpolointia.",
        "direction": "{first} minus {second}",
    },
}

#: Table and column labels by language.
LABELS = {
    "en": {
        "overview": "Dataset Overview", "quality": "Data Quality", "descriptive": "Descriptive Results",
        "primary": "Primary Analysis", "group": "Grouping variable", "variable": "Variable", "role": "Role",
        "valid_n": "Valid n", "missing_n": "Missing n", "missing_pct": "Missing (%)",
        "excluded_n": "Non-finite excluded", "outside_range": "Outside supplied range", "mean": "M", "sd": "SD",
        "median": "Median", "minimum": "Minimum", "maximum": "Maximum", "category": "Category", "count": "Count",
        "percent": "Percent of valid observations", "other": "Other",
    },
    "zh-CN": {
        "overview": "数据集概览", "quality": "数据质量", "descriptive": "描述性结果",
        "primary": "主要分析", "group": "分组变量", "variable": "变量", "role": "角色",
        "valid_n": "有效 n", "missing_n": "缺失 n", "missing_pct": "缺失（%）",
        "excluded_n": "排除的非有限值", "outside_range": "超出指定范围", "mean": "M", "sd": "SD",
        "median": "中位数", "minimum": "最小值", "maximum": "最大值", "category": "类别", "count": "计数",
        "percent": "占有效观测的百分比", "other": "其他",
    },
    "es": {
        "overview": "Descripción del conjunto", "quality": "Calidad de los datos", "descriptive": "Resultados descriptivos",
        "primary": "Análisis principal", "group": "Variable de grupo", "variable": "Variable", "role": "Rol",
        "valid_n": "n válido", "missing_n": "n faltante", "missing_pct": "Faltante (%)",
        "excluded_n": "No finitos excluidos", "outside_range": "Fuera del rango indicado", "mean": "M", "sd": "DE",
        "median": "Mediana", "minimum": "Mínimo", "maximum": "Máximo", "category": "Categoría", "count": "Frecuencia",
        "percent": "Porcentaje de observaciones válidas", "other": "Otros",
    },
    "fi": {
        "overview": "Aineiston yleiskuva", "quality": "Aineiston laatu", "descriptive": "Kuvailevat tulokset",
        "primary": "Pääanalyysi", "group": "Ryhmittelymuuttuja", "variable": "Muuttuja", "role": "Rooli",
        "valid_n": "Kelvollinen n", "missing_n": "Puuttuva n", "missing_pct": "Puuttuva (%)",
        "excluded_n": "Poissuljetut ei-äärelliset", "outside_range": "Ilmoitetun vaihteluvälin ulkopuolella", "mean": "KA", "sd": "KH",
        "median": "Mediaani", "minimum": "Minimi", "maximum": "Maksimi", "category": "Luokka", "count": "Lukumäärä",
        "percent": "Osuus kelvollisista havainnoista", "other": "Muut",
    },
}

#: Role names by language.
ROLE_LABELS = {
    "en": {"identifier": "identifier", "numeric": "numeric", "categorical": "categorical", "ordinal": "ordinal", "date": "date", "text": "text"},
    "zh-CN": {"identifier": "标识符", "numeric": "数值", "categorical": "分类", "ordinal": "有序", "date": "日期", "text": "文本"},
    "es": {"identifier": "identificador", "numeric": "numérico", "categorical": "categórico", "ordinal": "ordinal", "date": "fecha", "text": "texto"},
    "fi": {"identifier": "tunniste", "numeric": "numeerinen", "categorical": "luokka", "ordinal": "järjestysasteikko", "date": "päivämäärä", "text": "teksti"},
}

#: Names of report types, audiences and depths by language.
SETTING_LABELS = {
    "en": {
        "automatic": "automatic", "descriptive": "descriptive", "data_quality": "data quality", "group": "group comparison",
        "relationships": "relationships", "change": "change", "time": "date series", "researcher": "researcher",
        "educator": "educator", "business": "business/management", "general": "general audience", "brief": "brief",
        "standard": "standard", "detailed": "detailed",
    },
    "zh-CN": {
        "automatic": "自动", "descriptive": "描述性", "data_quality": "数据质量", "group": "组间比较",
        "relationships": "变量关系", "change": "前后变化", "time": "日期序列", "researcher": "研究人员",
        "educator": "教育工作者", "business": "商业/管理", "general": "一般读者", "brief": "简要",
        "standard": "标准", "detailed": "详细",
    },
    "es": {
        "automatic": "automático", "descriptive": "descriptivo", "data_quality": "calidad de datos", "group": "comparación de grupos",
        "relationships": "relaciones", "change": "cambio", "time": "serie por fecha", "researcher": "investigación",
        "educator": "educación", "business": "empresa/gestión", "general": "público general", "brief": "breve",
        "standard": "estándar", "detailed": "detallado",
    },
    "fi": {
        "automatic": "automaattinen", "descriptive": "kuvaileva", "data_quality": "aineiston laatu", "group": "ryhmävertailu",
        "relationships": "yhteydet", "change": "muutos", "time": "aikasarja", "researcher": "tutkija",
        "educator": "kouluttaja", "business": "liiketoiminta/johto", "general": "yleinen yleisö", "brief": "lyhyt",
        "standard": "tavallinen", "detailed": "laaja",
    },
}

#: Chart titles by language and chart kind; {a} and {b} are the display labels of the plotted variables.
CHART_TITLES = {
    "en": {
        "histogram": "Distribution of {a}", "bar": "Frequency of {a}", "missingness": "Missingness by variable",
        "box": "{a} by {b}", "scatter": "{a} and {b}", "paired": "Paired means: {a} and {b}",
        "date_line": "Date-level mean of {b}",
    },
    "zh-CN": {
        "histogram": "{a} 的分布", "bar": "{a} 的频数", "missingness": "各变量缺失率",
        "box": "按 {b} 分组的 {a}", "scatter": "{a} 与 {b}", "paired": "配对均值：{a} 与 {b}",
        "date_line": "{b} 的日期层面均值",
    },
    "es": {
        "histogram": "Distribución de {a}", "bar": "Frecuencia de {a}", "missingness": "Datos faltantes por variable",
        "box": "{a} por {b}", "scatter": "{a} y {b}", "paired": "Medias pareadas: {a} y {b}",
        "date_line": "Media por fecha de {b}",
    },
    "fi": {
        "histogram": "Muuttujan {a} jakauma", "bar": "Muuttujan {a} frekvenssit", "missingness": "Puuttuvat tiedot muuttujittain",
        "box": "{a} ryhmittäin: {b}", "scatter": "{a} ja {b}", "paired": "Parittaiset keskiarvot: {a} ja {b}",
        "date_line": "Muuttujan {b} päivätason keskiarvo",
    },
}

#: Terms a narrative may not use, by language.
BANNED_TERMS = {
    "en": ["statistically significant", "caused", "causes", "proved", "citation", "references"],
    "zh-CN": ["统计显著", "导致了", "证明了", "参考文献", "引用"],
    "es": ["estadísticamente significativo", "causó", "demostró", "referencias", "citación"],
    "fi": ["tilastollisesti merkitsevä", "aiheutti", "todisti", "lähdeviitteet", "viittaus"],
}

#: Methods named in the evidence facts.
FACT_METHODS = {
    "dataset": "row and column count",
    "missingness": "original missing count divided by all records",
    "numeric_descriptive": "finite observations; arithmetic mean; sample SD (ddof=1)",
    "group_difference": "complete finite cases; pooled sample SD",
    "relationship": "Pearson product-moment correlation on pairwise finite observations",
    "paired_change": "post minus pre on identical finite pairs",
    "date_series": "mean by confirmed date",
}


def sentence(language: str, kind: str) -> str:
    return SENTENCES[language][kind]


def label(language: str, key: str) -> str:
    """A label with English as fallback, then the key itself."""
    return LABELS.get(language, {}).get(key, LABELS["en"].get(key, key))
