"""Quality rules over one row of statistics a job, conclusions and reports: columns, no loops over rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Limits of the rules.
SMALL_SHARE, DOMINANT, LOW_SHARE, EDGE_SHARE = 0.5, 0.95, 0.3, 0.25
CHANGE_HIGH, CHANGE_LOW = 0.75, 0.001
LEAST_OVERLAP, OVERLAP_SHARE = 16, 0.05
# The messages that go with the codes, which deduplication compares.
MESSAGES = {
    "no_crs_warning": "输入或输出影像缺少 CRS，面积和空间叠加结论需人工复核。",
    "empty_result_warning": "结果为空，可能是阈值过高、模型不适配或输入质量不足。",
    "empty_change_warning": "变化检测未识别到变化像元。",
    "too_many_small_polygons_warning": "小斑块占比较高，可能存在噪声或切片拼接碎斑。",
    "single_class_dominance_warning": "单一类别占比超过 95%，需检查类别映射、阈值或输入影像。",
    "low_confidence_warning": "低置信度目标比例较高，建议人工复核。",
    "edge_object_ratio_warning": "边缘目标比例较高，存在切片截断或重复检测风险。",
    "change_area_too_high_warning": "变化面积比例过高，需重点检查配准、时相一致性和阈值。",
    "change_area_too_low_warning": "变化面积比例极低，可能无显著变化，也可能阈值过严。",
    "sr_transform_inconsistent_warning": "超分输出 transform 与 scale 不一致，空间定位需复核。",
    "tile_seam_risk_warning": "overlap 较小，存在切片边界拼接痕迹风险。",
}

#: Columns that the rules read; a job's row may lack any of them.
FACTS = {
    "has_crs_key": "boolean", "crs": "string", "target_count": "bigint", "instance_count": "bigint", "changed_pixels": "bigint", "connected_component_count": "bigint", "small_patch_count": "bigint",
    "dominant_ratio": "double", "dominant_class": "string", "class_ratios": "string", "mean_confidence": "double", "total_area_km2": "double", "changed_area_km2": "double", "max_patch_area_m2": "double",
    "shape_matches_scale": "boolean", "mean": "double", "min": "double", "max": "double", "low_confidence_ratio": "double", "edge_object_ratio": "double", "change_area_ratio": "double", "type": "string", "transform_matches_scale": "boolean", "tile_size": "int", "overlap": "int",
}


def with_facts(jobs: DataFrame) -> DataFrame:
    return jobs.withColumns({n: F.lit(None).cast(t) for n, t in FACTS.items() if n not in jobs.columns})


def _tests() -> list[tuple[str, str, Column]]:
    c = F.col
    small = F.when(c("connected_component_count") > 0, c("small_patch_count") / c("connected_component_count"))
    return [
        ("no_crs_warning", "no_crs_warning", c("has_crs_key") & (F.coalesce(c("crs"), F.lit("")) == "")),
        ("empty_result_warning", "empty_result_warning", (c("target_count").eqNullSafe(0)) | (c("instance_count").eqNullSafe(0))),
        ("empty_result_warning", "empty_change_warning", c("changed_pixels") == 0),
        ("too_many_small_polygons_warning", "too_many_small_polygons_warning", small > SMALL_SHARE),
        ("single_class_dominance_warning", "single_class_dominance_warning", c("dominant_ratio") > DOMINANT),
        ("low_confidence_warning", "low_confidence_warning", c("low_confidence_ratio") > LOW_SHARE),
        ("edge_object_ratio_warning", "edge_object_ratio_warning", c("edge_object_ratio") > EDGE_SHARE),
        ("change_area_too_high_warning", "change_area_too_high_warning", c("change_area_ratio") > CHANGE_HIGH),
        ("change_area_too_low_warning", "change_area_too_low_warning", (c("change_area_ratio") >= 0) & (c("change_area_ratio") < CHANGE_LOW)),
        ("sr_transform_inconsistent_warning", "sr_transform_inconsistent_warning", (c("type") == "super_resolution") & ~F.coalesce(c("transform_matches_scale"), F.lit(True))),
        ("tile_seam_risk_warning", "tile_seam_risk_warning", (c("tile_size") > 0) & (c("overlap") < F.greatest(F.lit(float(LEAST_OVERLAP)), c("tile_size") * OVERLAP_SHARE))),
    ]


def run_checks(jobs: DataFrame, key: str = "job_id", existing: DataFrame | None = None) -> DataFrame:
    """key, seq, code, severity, message of each job: flags that were there, then the rules' in order, the first of equal ones."""
    flags = [F.when(test, F.struct(F.lit(code).alias("code"), F.lit("warning").alias("severity"), F.lit(MESSAGES[m]).alias("message"))) for code, m, test in _tests()]
    rows = with_facts(jobs).select(key, F.posexplode(F.array_compact(F.array(*flags))).alias("seq", "f")).select(key, (F.col("seq") + 1_000_000).alias("seq"), "f.*")
    if existing is not None:
        rows = existing.select(key, F.col("seq").cast("int").alias("seq"), "code", "severity", "message").unionByName(rows)
    return deduplicate(rows, key)


def deduplicate(flags: DataFrame, key: str = "job_id") -> DataFrame:
    """The first flag of each code and message, numbered from 1 in their order."""
    first = flags.groupBy(key, "code", "message").agg(F.min(F.struct("seq", "severity")).alias("f")).select(key, F.col("f.seq").alias("s"), "code", "f.severity", "message")
    return first.withColumn("seq", F.row_number().over(Window.partitionBy(key).orderBy("s"))).drop("s")


def confidence(flags: DataFrame, key: str = "job_id") -> DataFrame:
    """high; medium with a warning; low with an error or a doubt about the georeference."""
    risky = F.col("code").isin("georeference_mismatch", "no_crs_warning") | (F.col("severity") == "error")
    rows = flags.groupBy(key).agg(F.bool_or(risky).alias("r"), F.bool_or(F.col("severity").isin("error", "warning")).alias("s"), F.count("*").alias("flag_count"))
    return rows.select(key, F.when(F.col("r"), "low").when(F.col("s"), "medium").otherwise("high").alias("confidence"), "flag_count")


# The wording of conclusions, with the numbers' formats.
DETECTING = ("object_detection", "oriented_detection", "instance_segmentation")


def conclusion_summary(task: Column) -> Column:
    """One sentence from a row of facts: task, target_count, mean_confidence, total_area_km2, dominant_class, changed_area_km2, change_area_ratio, mean, flag_count."""
    c = F.col
    text = lambda form, *args: F.format_string(form, *args)
    return (
        F.when(task.isin(*DETECTING), text("本次任务识别到 %d 个目标，平均置信度为 %.3f，质量标记 %d 项。", F.coalesce("target_count", "instance_count", F.lit(0)), F.coalesce("mean_confidence", F.lit(0.0)), c("flag_count")))
        .when(task == "semantic_segmentation", text("本次语义分割覆盖约 %.6f km2，主导类别为 %s，质量标记 %d 项。", F.coalesce("total_area_km2", F.lit(0.0)), F.coalesce("dominant_class", F.lit("None")), c("flag_count")))
        .when(task == "change_detection", text("本次变化检测变化面积约 %.6f km2，占比 %.3f%%，质量标记 %d 项。", F.coalesce("changed_area_km2", F.lit(0.0)), F.coalesce("change_area_ratio", F.lit(0.0)) * 100, c("flag_count")))
        .when(task == "super_resolution", F.lit("本次超分辨率结果已完成 transform 和输出尺寸检查；无参考真值时不评价 PSNR、SSIM 或实际清晰度提升。"))
        .when(task == "spectral_indices", text("本次光谱指数统计均值为 %.4f，需结合地物类型解释。", F.coalesce("mean", F.lit(0.0))))
        .otherwise(F.concat(F.lit("任务 "), task, F.lit(" 已完成统计和质量检查。")))
    )


def key_findings() -> Column:
    """What a row of facts has to say, in order: targets, classes, change, scale, range of an index."""
    c = F.col
    text = F.format_string
    word = lambda name: F.coalesce(F.initcap(c(name).cast("string")), F.lit("None"))
    zero = lambda name, v: F.coalesce(c(name), F.lit(v))
    groups = [
        (c("target_count").isNotNull(), [text("目标数量：%d", "target_count"), text("低置信度比例：%.3f", zero("low_confidence_ratio", 0.0))]),
        (c("class_ratios").isNotNull(), [text("类别占比：%s", "class_ratios"), text("连通域数量：%d", zero("connected_component_count", 0))]),
        (c("change_area_ratio").isNotNull(), [text("变化面积占比：%.3f%%", c("change_area_ratio") * 100), text("最大变化斑块面积：%.2f m2", zero("max_patch_area_m2", 0.0))]),
        (c("type") == "super_resolution", [text("输出尺寸是否匹配 scale：%s", word("shape_matches_scale")), text("transform 是否匹配 scale：%s", word("transform_matches_scale"))]),
        (c("type") == "spectral_index", [text("指数范围：%s 至 %s", F.coalesce(c("min").cast("string"), F.lit("None")), F.coalesce(c("max").cast("string"), F.lit("None")))]),
    ]
    found = F.array_compact(F.array(*[F.when(test, line) for test, lines in groups for line in lines]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("无额外关键统计发现。")))


def conclusion(task: Column, flags: Column) -> dict[str, Column]:
    """All parts of a conclusion over a row of facts and its flags (array of struct<code, severity, message>)."""
    codes = F.transform(flags, lambda f: f["code"])
    risky = F.exists(flags, lambda f: f["code"].isin("georeference_mismatch", "no_crs_warning") | (f["severity"] == "error"))
    level = F.when(risky, "low").when(F.exists(flags, lambda f: f["severity"].isin("error", "warning")), "medium").otherwise("high")
    return {
        "summary": conclusion_summary(task), "confidence": level, "key_findings": key_findings(), "limitations": limitations(task, flags), "recommended_review_areas": review_areas(task, codes), "next_steps": next_steps(task, codes),
    }


def limitations(task: Column, flags: Column) -> Column:
    """flags: array of struct<code, message>."""
    first = [
        F.lit("未提供人工真值，因此不输出 IoU、mAP、PSNR 等监督评价指标。"),
        F.when(task == "change_detection", "变化检测结论依赖两期影像配准质量；若 CRS、分辨率或对齐存在问题，变化面积可能失真。"),
        F.when(task == "super_resolution", "无参考超分只能检查尺寸、transform 和基础统计，不能声称结果更清晰或更准确。"),
    ]
    return F.concat(F.array_compact(F.array(*first)), F.transform(flags, lambda f: F.concat_ws(": ", f["code"], f["message"])))


def review_areas(task: Column, codes: Column) -> Column:
    has = lambda code: F.array_contains(codes, code)
    found = F.array_compact(F.array(
        F.when(has("low_confidence_warning"), "低置信度目标集中区域"), F.when(has("too_many_small_polygons_warning"), "小斑块密集区域"),
        F.when(task == "change_detection", "最大变化斑块及其周边"), F.when(task == "super_resolution", "道路、建筑边缘等高频纹理区域"),
    ))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("抽样检查主要输出区域")))


def next_steps(task: Column, codes: Column) -> Column:
    return F.array_compact(F.array(
        F.lit("核对输出文件路径并抽样人工复核。"), F.when(F.size(codes) > 0, "优先处理 quality_flags 中的 warning/error。"),
        F.when(task.isin(*DETECTING), "如目标漏检或误检较多，调整置信度阈值或更换真实模型 adapter。"), F.when(task == "change_detection", "复核两期影像配准和时相差异。"),
    ))


def default_conclusion(task: Column, status: Column, errors: Column, warnings: Column) -> Column:
    return (
        F.when(status == "failed", F.concat(task, F.lit(" failed.")))
        .when(errors > 0, F.format_string("%s completed with %d error quality flag(s).", task, errors))
        .when(warnings > 0, F.format_string("%s completed with %d warning quality flag(s).", task, warnings))
        .otherwise(F.concat(task, F.lit(" completed successfully.")))
    )


# Sections of the analysis report, in order.
SECTIONS = ["数据概况", "使用模型", "参数设置", "推理结果", "统计分析", "质量检查", "风险与局限", "结论", "建议人工复核区域", "下一步建议", "输出文件清单"]
EMPTY = {"outputs": "- 无输出文件记录。", "statistics": "- 无统计结果。", "flags": "- 未发现质量检查标记。", "list": "- 无。"}


def bullet_list(items: Column) -> Column:
    return F.when(F.size(items) > 0, F.array_join(F.transform(items, lambda i: F.concat(F.lit("- "), i)), "\n")).otherwise(F.lit(EMPTY["list"]))


def bullet_map(pairs: Column, empty: str) -> Column:
    """pairs: array of struct<key, value>, in order."""
    return F.when(F.size(pairs) > 0, F.array_join(F.transform(pairs, lambda p: F.format_string("- %s: `%s`", p["key"], p["value"])), "\n")).otherwise(F.lit(EMPTY[empty]))


def flag_lines(flags: Column) -> Column:
    line = lambda f: F.format_string("- [%s] %s: %s", f["severity"], f["code"], f["message"])
    return F.when(F.size(flags) > 0, F.array_join(F.transform(flags, line), "\n")).otherwise(F.lit(EMPTY["flags"]))


def report_markdown(parts: Mapping[str, Column]) -> Column:
    """The analysis report: a heading, then SECTIONS with the text given for each."""
    lines = [F.lit("# 遥感处理分析报告"), F.lit("")]
    for name in SECTIONS:
        lines += [F.lit(f"## {name}"), F.coalesce(parts[name], F.lit("")), F.lit("")]
    return F.concat_ws("\n", *lines)
