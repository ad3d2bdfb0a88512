"""The queries in DuckDB SQL, by brute force, on the same tables."""

from __future__ import annotations

from .queries import MEAN, R_LIST, SIZE, STD

NU = 0.5
#: Halvings of the quarter circle, in the search for the direction of the one-class weights.
HALVINGS = 48


def _f6(v: str) -> str:
    return f"array_to_string(list_transform({v}, lambda x: printf('%.6f', round(x, 6) + 0.0)), ' ')"


def _norm(v: str) -> str:
    return f"list_transform({v}, lambda x: x / sqrt(list_sum(list_transform({v}, lambda y: y * y))))"


def _interval(d: str, lo: float, hi: float) -> str:
    """Mean of ranks kmin + 1 .. kmax of the list ``d``."""
    bound = lambda k: f"floor(len({d}) * {float(k)}::double)::int" if k < 1 else f"least({int(k)}, len({d}))::int"
    a, b = f"least({bound(lo)}, {bound(hi)})", f"greatest({bound(lo)}, {bound(hi)})"
    return f"case when {b} > {a} then list_sum(list_sort({d})[{a} + 1:{b}]) / ({b} - {a}) else 'nan'::double end"


def _fit(name: str, pairs: str, keys: str) -> str:
    """Halve the range of directions in which the mean of the lowest share NU of the projections is largest; at either end, that share's mean point (a1, a2 and b1, b2)."""
    each = ", ".join(f"f.{k}" for k in keys.split(", "))
    ranked = f"select {each}, f.t, f.lo, f.hi, f.a1, f.a2, f.b1, f.b2, (f.lo + f.hi) / 2 as mid, p.x1, p.x2, {NU}::double * count(*) over (partition by {each}) as share, row_number() over (partition by {each} order by cos((f.lo + f.hi) / 2) * p.x1 + sin((f.lo + f.hi) / 2) * p.x2) as rk from {name} f join {pairs} p using ({keys}) where f.t < {HALVINGS}"
    means = f"select {keys}, t, lo, hi, a1, a2, b1, b2, mid, sum(greatest(0, least(1, share - rk + 1)) * x1) / any_value(share) as z1, sum(greatest(0, least(1, share - rk + 1)) * x2) / any_value(share) as z2 from ({ranked}) group by all"
    turned = f"select *, cos(mid) * z2 - sin(mid) * z1 > 0 as further from ({means})"
    step = f"select {keys}, t + 1, case when further then mid else lo end, case when further then hi else mid end, case when further then z1 else a1 end, case when further then z2 else a2 end, case when further then b1 else z1 end, case when further then b2 else z2 end from ({turned})"
    none = ", ".join(f"null::double as {c}" for c in ("a1", "a2", "b1", "b2"))
    return f"select distinct {keys}, 0 as t, 0.0::double as lo, pi() / 2 as hi, {none} from {pairs} union all {step}"


def _weights(fit: str, pairs: str, keys: str, shown: str) -> str:
    """The point of the last range's chord that is closest to the origin, and the quantile of the projections on it."""
    ends = f"select {keys}, coalesce(a1, b1) as a1, coalesce(a2, b2) as a2, coalesce(b1, a1) - coalesce(a1, b1) as u1, coalesce(b2, a2) - coalesce(a2, b2) as u2 from {fit} where t = {HALVINGS}"
    at = f"select *, case when u1 * u1 + u2 * u2 > 0 then greatest(0, least(1, -(a1 * u1 + a2 * u2) / (u1 * u1 + u2 * u2))) else 0 end as m from ({ends})"
    w = f"select {keys}, a1 + m * u1 as w1, a2 + m * u2 as w2 from ({at})"
    ranked = f"select {keys}, w1, w2, w1 * x1 + w2 * x2 as s, row_number() over (partition by {keys} order by w1 * x1 + w2 * x2) as rk, ceil({NU}::double * count(*) over (partition by {keys}) - 1e-9::double) as k from ({w}) join {pairs} p using ({keys})"
    return f'select {shown}, w1, w2, s as "offset" from ({ranked}) where rk = k'


#: Common tables: name -> (what it needs, SQL). A name may refer to those above it.
CTES: dict[str, str] = {
    "emb": "select vec_id as image_id, 'c' || label as category, list_transform(embedding, lambda x: x::double) as e from embeddings",
    "img": "select *, 'data/' || category || '/test/' || anomaly_type || '/' || img_name as path from (select category, 0 as subset, image_id, (image_id % 4 = 0)::int as is_anomaly, case when image_id % 4 = 0 then 'defect_' || image_id % 3 else 'good' end as anomaly_type, image_id || '.png' as img_name from emb)",
    "pat": "select category, 0 as subset, image_id, backbone, layer, p as patch_id, p // 4 as gy, p % 4 as gx, v[4 * p + 1:4 * p + 4] as feat from (select category, image_id, backbone, layer, case when layer = 0 then w else list_reverse(w) end as v from (select category, image_id, backbone, case when backbone = 1 then e else e[33:64] || e[1:32] end as w from emb, (values (1), (2)) b(backbone)), (values (0), (1)) l(layer)), (select unnest(range(0, 16))::int as p)",
    "unit": f"select category, subset, image_id, backbone, layer, patch_id, gy, gx, {_norm('feat')} as feat from pat",
    "isc": "select category, image_id, list_max(e) as score, (image_id % 4 = 0)::int as is_anomaly from emb",
    "refs": "select category, image_id, score from (select *, row_number() over (partition by category order by score, image_id) as rk, count(*) over (partition by category) as n from isc) where rk <= floor(case when n <= 50 then 0.25::double when n <= 100 then 0.2::double else 0.15::double end * n)",
    "rpat": "select unit.* from unit join refs using (category, image_id)",
    # distances of patches to other images, and to references
    "pim": "select a.category, a.subset, a.layer, a.image_id, a.patch_id, b.image_id as ref_image_id, min(list_distance(a.feat, b.feat)) as d from unit a join unit b on a.category = b.category and a.layer = b.layer and a.image_id <> b.image_id where a.backbone = 1 and b.backbone = 1 group by all",
    "prm": "select a.category, a.subset, a.layer, a.backbone, a.image_id, a.patch_id, b.image_id as ref_image_id, min(list_distance(a.feat, b.feat)) as d from unit a join rpat b on a.category = b.category and a.layer = b.layer and a.backbone = b.backbone where a.layer = 0 group by all",
    "ms": f"select category, subset, layer, image_id, patch_id, {_interval('l', 0, 0.3)} as score from (select category, subset, layer, image_id, patch_id, list(d) as l from pim group by all)",
    "rm": f"select category, subset, layer, backbone, image_id, patch_id, {_interval('l', 0.02, 0.3)} as m from (select category, subset, layer, backbone, image_id, patch_id, list(d) as l from prm group by all)",
    "means": "select a.category, a.subset, a.layer, a.image_id, a.patch_id, a.m as m1, b.m as m2, a.m as x1, 0.5::double * b.m as x2 from rm a join rm b using (category, subset, layer, image_id, patch_id) where a.backbone = 1 and b.backbone = 2",
    "pairs": "select a.category, a.subset, a.layer, a.image_id, a.patch_id, a.ref_image_id, a.d as x1, 0.5::double * b.d as x2 from prm a join prm b using (category, subset, layer, image_id, patch_id, ref_image_id) join refs using (category, image_id) where a.backbone = 1 and b.backbone = 2",
    "fit": _fit("fit", "pairs", "category"),
    "wts": _weights("fit", "pairs", "category", "category, 0 as subset, 0 as layer"),
    "sim": "select a.category, a.image_id as src, b.image_id as dst, list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])) as w from emb a join emb b using (category)",
    "top": "select * from (select *, row_number() over (partition by category, src order by round(w, 9) desc, dst)::int as rk from sim) where rk <= 3",
    "mm": "select category, image_id, (score - min(score) over (partition by category)) / (max(score) over (partition by category) - min(score) over (partition by category)) as score from isc",
    "taps": f"select i, g, sum(w) as w from (select i, floor(src)::int as g, 1 - (src - floor(src)) as w from (select i, i * 3.0::double / {SIZE - 1} as src from (select unnest(range(0, {SIZE}))::int as i)) union all select i, least(floor(src)::int + 1, 3), src - floor(src) from (select i, i * 3.0::double / {SIZE - 1} as src from (select unnest(range(0, {SIZE}))::int as i))) group by all",
    "up": "select category, image_id, ty.i as y, tx.i as x, sum(score * ty.w * tx.w) as score from ms join taps ty on patch_id // 4 = ty.g join taps tx on patch_id % 4 = tx.g where layer = 0 group by all",
    # layer norm and box means, a row per channel
    "lng": "select category, subset, image_id, backbone, layer, patch_id, gy, gx, unnest(feat) as x, generate_subscripts(feat, 1) as c from pat",
    "lnz": "select lng.* exclude (x), (x - mu) / sqrt(va + 1e-5::double) as z from lng join (select image_id, backbone, layer, avg(x) as mu, var_pop(x) as va from lng group by all) using (image_id, backbone, layer)",
    "box": "select a.category, a.subset, a.image_id, a.backbone, a.layer, r as degree, a.patch_id, a.gy, a.gx, a.c, sum(b.z / (r * r)) as v from lnz a, (values (1), (3), (5)) d(r), lnz b where a.image_id = b.image_id and a.backbone = b.backbone and a.layer = b.layer and a.c = b.c and abs(a.gy - b.gy) <= (r - 1) // 2 and abs(a.gx - b.gx) <= (r - 1) // 2 group by all",
    "agg": "select category, subset, image_id, backbone, layer, degree, patch_id, gy, gx, list(v / n order by c) as feat from (select *, sqrt(sum(v * v) over (partition by image_id, backbone, layer, degree, patch_id)) as n from box) group by all",
    "ev": "select event_type as grp, value as score, (user_id % 5 = 0)::int as label from events",
    "ev3": "select event_type as grp, value as score, (user_id % 3 = 0)::int as label from events",
    "li": "select l_linestatus as grp, l_extendedprice as score, (l_returnflag = 'R')::int as label from lineitem",
    "px": "select a.category, a.image_id, p // 8 as y, p % 8 as x, a.e[p + 1] as score, (b.e[p + 1] > 0.15::double)::int as mask from emb a join emb b on b.image_id = a.image_id + 1, (select unnest(range(0, 64))::int as p)",
    "reach": "select image_id, y, x, y as y2, x as x2 from px where mask = 1 union select r.image_id, r.y, r.x, p.y, p.x from reach r join px p on p.image_id = r.image_id and p.mask = 1 and abs(p.y - r.y2) <= 1 and abs(p.x - r.x2) <= 1",
    "reg": "select category, image_id, y, x, region from px join (select image_id, y, x, min(y2 * 8 + x2)::int as region from reach group by all) using (image_id, y, x)",
    "ends": "select category, min(score) as lo, max(score) as hi, (max(score) - min(score)) / 200 as delta, sum(1 - mask) as clean from px group by category",
    "ths": "select category, clean, unnest(range(0, ceil((hi - lo) / delta)::int))::int as step, lo, delta from ends",
    "area": "select category, image_id, region, count(*) as area from reg group by all",
    "shares": "select p.category, p.score, 1 - p.mask as clean, case when a.area is null then 0 else 1.0::double / a.area end as share from px p left join reg g using (category, image_id, y, x) left join area a on a.category = g.category and a.image_id = g.image_id and a.region = g.region",
    "roc": "select t.category, t.step, t.lo + t.step * t.delta as threshold, sum(case when s.score > t.lo + t.step * t.delta then s.share else 0 end) / any_value(n.n) as overlap, sum(case when s.score > t.lo + t.step * t.delta then s.clean else 0 end) / any_value(t.clean)::double as fpr from ths t join shares s using (category) join (select category, count(*) as n from area group by category) n using (category) group by all",
    "pro": "select category, sum((x - px) * (overlap + po) / 2) as aupro from (select *, lag(x) over w as px, lag(overlap) over w as po from (select *, (fpr - min(fpr) over (partition by category)) / nullif(max(fpr) over (partition by category) - min(fpr) over (partition by category), 0) as x from roc where fpr < 0.3::double) window w as (partition by category order by step desc)) group by category",
    "spm": "select category as grp, score, is_anomaly as label from isc",
    "pxm": "select category as grp, score, mask as label from px",
}
RECURSIVE = ("fit", "reach")


def _curve(table: str) -> str:
    return f"select grp, score, p, n, sum(p) over w as tp, sum(n) over w as fp, sum(p) over (partition by grp) as n1, sum(n) over (partition by grp) as n0 from (select grp, score, sum((label = 1)::int) as p, sum((label <> 1)::int) as n from {table} group by all) window w as (partition by grp order by score desc rows unbounded preceding)"


for _t in ("ev", "ev3", "li", "spm", "pxm"):
    CTES[f"cv_{_t}"] = _curve(_t)
    CTES[f"met_{_t}"] = f"select grp, any_value(n1) as n1, any_value(n0) as n0, sum(n * (2 * tp - p))::double / 2 / nullif(any_value(n1)::double * any_value(n0)::double, 0) as auroc, sum(p * tp::double / (tp + fp)) / nullif(any_value(n1), 0) as ap, max(case when tp > 0 then 2.0::double * tp / (tp + fp + n1) end) as f1 from cv_{_t} group by grp"


def _with(sql: str) -> str:
    """Put the common tables that a statement uses, and those they use, before it."""
    import re

    need: set[str] = set()

    def visit(text: str) -> None:
        for name in set(re.findall(r"\b(?:from|join|,)\s*(\w+)", text)) & CTES.keys() - need:
            need.add(name)
            visit(CTES[name])

    visit(sql)
    names = [n for n in sorted(need, key=lambda n: _depth(n))]
    head = "with recursive " if need & set(RECURSIVE) else "with "
    return (head + ", ".join(f"{n} as {'materialized ' if n not in RECURSIVE else ''}({CTES[n]})" for n in names) + " " if names else "") + sql


def _depth(name: str) -> int:
    import re

    used = (set(re.findall(r"\b(?:from|join|,)\s*(\w+)", CTES[name])) & CTES.keys()) - {name}
    return 1 + max((_depth(n) for n in used), default=0)


def _smooth(ks: list[int]) -> str:
    values = ", ".join(f"({k})" for k in ks)
    return f"select category, src as image_id, round(avg(s), 6) as score from (select t.category, t.src, k, sum(w * mm.score) / sum(w) as s from top t join (values {values}) ks(k) on t.rk <= k join mm on mm.category = t.category and mm.image_id = t.dst group by all) group by all"


def _report() -> str:
    names = {"auroc_px": "x.auroc", "f1_px": "x.f1", "ap_px": "x.ap", "aupro": "pro.aupro"}
    px = ", ".join(f"case when x.n1 > 0 then {v} else 0 end as {k}" for k, v in names.items())
    sp = ", ".join(f"case when s.n1 > 0 and s.n0 > 0 then s.{v} else 0 end as {k}" for k, v in {"auroc_sp": "auroc", "f1_sp": "f1", "ap_sp": "ap"}.items())
    every = [*names, "auroc_sp", "f1_sp", "ap_sp"]
    rows = f"select x.grp as category, {px}, {sp} from met_pxm x join met_spm s on s.grp = x.grp left join pro on pro.category = x.grp"
    return f"select category, {', '.join(f'round({c} * 100, 6) as {c}' for c in every)} from ({rows}) union all select 'mean', {', '.join(f'round(avg({c} * 100), 6)' for c in every)} from ({rows})"


def _event_report() -> str:
    every = ["auroc_px", "f1_px", "ap_px", "aupro", "auroc_sp", "f1_sp", "ap_sp"]
    rows = "select a.grp as category, a.auroc as auroc_px, a.f1 as f1_px, a.ap as ap_px, a.n1 / (a.n1 + a.n0)::double as aupro, b.auroc as auroc_sp, b.f1 as f1_sp, b.ap as ap_sp from met_ev a join met_ev3 b using (grp)"
    return f"select category, {', '.join(f'round({c} * 100, 6) as {c}' for c in every)} from ({rows}) union all select 'mean', {', '.join(f'round(avg({c} * 100), 6)' for c in every)} from ({rows})"


def _pipeline_mutual() -> str:
    aggregated = "p0 as materialized (select * from agg where backbone = 1 and degree = 1)"
    d = "pd as materialized (select a.category, a.layer, a.image_id, a.patch_id, b.image_id as ref, min(list_distance(a.feat, b.feat)) as d from p0 a join p0 b on a.category = b.category and a.layer = b.layer and a.image_id <> b.image_id group by all)"
    s = f"ps as materialized (select category, image_id, patch_id, avg(s) as score from (select category, layer, image_id, patch_id, {_interval('list(d)', 0, 0.3)} as s from pd group by all) group by all)"
    im = "pi as materialized (select category, image_id, max(score) as score from (select category, image_id, ty.i as y, tx.i as x, sum(score * ty.w * tx.w) as score from ps join taps ty on patch_id // 4 = ty.g join taps tx on patch_id % 4 = tx.g group by all) group by all)"
    return aggregated, d, s, im


def _pipelines() -> dict[str, str]:
    parts = _pipeline_mutual()
    base = _with("select 1 from agg, taps, top")
    head = base[: base.rindex("select 1 from agg")].rstrip()
    k = ", ".join(f"({x})" for x in (1, 2, 3))
    smoothed = lambda scores: f"mm2 as (select category, image_id, (score - min(score) over (partition by category)) / (max(score) over (partition by category) - min(score) over (partition by category)) as score from {scores}) select category, src as image_id, round(avg(s), 6) as score from (select t.category, t.src, k, sum(w * mm2.score) / sum(w) as s from top t join (values {k}) ks(k) on t.rk <= k join mm2 on mm2.category = t.category and mm2.image_id = t.dst group by all) group by all"
    mutual = f"{head}, {', '.join(parts)}, {smoothed('pi')}"
    degrees = ", ".join(str(r) for r in R_LIST)
    chosen = "ch as materialized (select category, image_id from (select *, row_number() over (partition by category order by score, image_id) as rk, count(*) over (partition by category) as n from pi) where rk <= floor(case when n <= 50 then 0.25::double when n <= 100 then 0.2::double else 0.15::double end * n))"
    za = f"za as materialized (select * from agg where degree in ({degrees}))"
    zd = "zd as materialized (select a.category, a.layer, a.degree, a.backbone, a.image_id, a.patch_id, b.image_id as ref, min(list_distance(a.feat, b.feat)) as d from za a join za b on a.category = b.category and a.layer = b.layer and a.degree = b.degree and a.backbone = b.backbone join ch on ch.category = b.category and ch.image_id = b.image_id group by all)"
    zp = "zp as materialized (select a.category, a.layer, a.degree, a.d as x1, 0.5::double * b.d as x2 from zd a join zd b using (category, layer, degree, image_id, patch_id, ref) join ch using (category, image_id) where a.backbone = 1 and b.backbone = 2)"
    zf = f"zf as ({_fit('zf', 'zp', 'category, layer, degree')})"
    zw = f"zw as materialized ({_weights('zf', 'zp', 'category, layer, degree', 'category, layer, degree')})"
    zm = f"zm as materialized (select category, layer, degree, backbone, image_id, patch_id, {_interval('list(d)', 0.02, 0.3)} as m from zd group by all)"
    zs = f"zs as materialized (select category, image_id, patch_id, avg(s) as score from (select a.category, a.degree, a.image_id, a.patch_id, avg((f.w1 * a.m + f.w2 * 0.5::double * b.m) * b.m * a.m) as s from zm a join zm b using (category, layer, degree, image_id, patch_id) join zw f using (category, layer, degree) where a.backbone = 1 and b.backbone = 2 group by all) group by all)"
    zi = "zi as materialized (select category, image_id, max(score) as score from (select category, image_id, ty.i as y, tx.i as x, sum(score * ty.w * tx.w) as score from zs join taps ty on patch_id // 4 = ty.g join taps tx on patch_id % 4 = tx.g group by all) group by all)"
    fused = f"{head.replace('with ', 'with recursive ', 1)}, {', '.join([*parts, chosen, za, zd, zp, zf, zw, zm, zs, zi])}, {smoothed('zi')}"
    return {"pipeline_mutual": mutual, "pipeline_fused": fused}


def oracle_sql() -> dict[str, str]:
    mean, std = (f"[{', '.join(f'{x}::double' for x in v)}]" for v in (MEAN, STD))
    curve = "category, round(threshold, 6) as threshold, round(overlap, 6) as overlap, round(fpr, 6) as fpr, step"
    half = "select i, floor(s)::int as g, 1 - (s - floor(s)) as w from hs union all select i, least(floor(s)::int + 1, 3), s - floor(s) from hs"
    plain = {
        "image_inventory": "select category, 'test' as split, anomaly_type, is_anomaly, count(*) as images, sum(length(img_name) + 1)::bigint as bytes from img group by all",
        "extract_features": f"select category, image_id, backbone, layer, patch_id, {_f6('feat')} as feat from pat where backbone = 1 union all select category, image_id, 1, -1, -1, {_f6('list_transform([1, 2, 3, 4], lambda c: list_avg(list_transform(range(0, 16), lambda p: e[4 * p + c])))')} from emb",
        "consolidate_class_features": f"select 'mvtec' as dataset, category, image_id, {_f6('e')} as vec from emb where image_id % 5 <> 0 and image_id % 7 <> 0 and image_id % 2 = 0",
        "write_report": _report(),
        "write_maps": "select category, anomaly_type, count(*) as pixels, sum(bin)::bigint as total from (select p.category, img.anomaly_type, case when (score - min(score) over (partition by p.image_id)) / (max(score) over (partition by p.image_id) - min(score) over (partition by p.image_id) + 1e-10::double) > 0.5 then 255 else 0 end as bin from px p join img on img.image_id = p.image_id) group by all",
        "select_categories": "select category, image_id, path from img where category in ('c1', 'c3')",
        "assign_subsets": "select category, image_id, (ntile(3) over (partition by category order by md5(image_id || ':0'), image_id) - 1)::int as subset from img",
        "select_layers": f"select category, image_id, layer, patch_id, {_f6('feat')} as feat from pat where backbone = 1 and layer = 1",
        "grid_coords": "select image_id, backbone, layer, patch_id, gy, gx from pat where backbone = 1",
        "drop_normal_types": "select category, image_id, anomaly_type, is_anomaly from img where anomaly_type not in ('good', 'Normal', 'ok') and is_anomaly <> 0",
        "binary_mask": "select image_id, y, x, case when (score - min(score) over w) / (max(score) over w - min(score) over w + 1e-10::double) > 0.5 then 255 else 0 end as \"binary\" from px window w as (partition by image_id)",
        "percentile_mask": "select image_id, y, x, case when score > quantile_cont(score, 0.95) over (partition by image_id) then 255 else 0 end as \"binary\" from px",
        "heat_levels": "select image_id, y, x, floor((score - min(score) over w) / (max(score) over w - min(score) over w) * 255)::int as level, floor((score - min(score) over ()) / (max(score) over () - min(score) over ()) * 255)::int as whole_level from px window w as (partition by image_id)",
        "channel_standardize": f"select image_id, patch_id, {_f6(f'list_transform(feat, lambda x, i: (x - {mean}[i]) / {std}[i])')} as feat from pat where backbone = 1 and layer = 0",
        "l2_normalize": f"select image_id, patch_id, {_f6('feat')} as feat from unit where backbone = 1 and layer = 0",
        "layer_norm_image": f"select image_id, layer, patch_id, {_f6('list(z order by c)')} as feat from lnz where backbone = 1 group by image_id, layer, patch_id",
        "unfold_patches": f"select image_id, oy, ox, dy, dx, {_f6('feat')} as feat from (select image_id, gy + 1 - dy as oy, gx + 1 - dx as ox, dy, dx, feat from pat, (select unnest(range(0, 3))::int as dy), (select unnest(range(0, 3))::int as dx) where backbone = 1 and layer = 0) where oy between 0 and 3 and ox between 0 and 3",
        "adaptive_avg_pool": f"select image_id, {_f6('list_transform(range(0, 7), lambda i: list_avg(e[floor(i * 64 / 7.0)::int + 1:ceil((i + 1) * 64 / 7.0)::int]))')} as vec from emb",
        "local_aggregate": f"select image_id, layer, gy, gx, {_f6('feat')} as feat from agg where backbone = 1 and degree = 3",
        "local_aggregate_multi": f"select image_id, layer, degree, gy, gx, {_f6('feat')} as feat from agg where backbone = 1",
        "upsample_map": "select category, image_id, y, x, round(score, 6) as score from up",
        "patch_to_image_min": "select category, subset, layer, image_id, patch_id, ref_image_id, round(d, 6) as d from pim where layer = 0",
        "patch_to_reference_min": "select category, subset, layer, image_id, patch_id, ref_image_id, round(d, 6) as d from prm where backbone = 1",
        "fuser_training_pairs": "select category, subset, layer, image_id, patch_id, ref_image_id, round(x1, 6) as x1, round(x2, 6) as x2 from pairs",
        "join_backbones": "select category, subset, layer, image_id, patch_id, round(m1, 6) as m1, round(m2, 6) as m2, round(x1, 6) as x1, round(x2, 6) as x2 from means",
        "semi_join_reference": f"select category, image_id, patch_id, {_f6('feat')} as feat from rpat where backbone = 1 and layer = 0",
        "image_similarity": "select category, src, dst, round(w, 6) + 0.0 as w from sim",
        "rescore_external": _smooth([1, 2, 3]).replace("select category, src", "select 'mvtec_ad' as dataset, category, src", 1),
        "interval_mean": f"select image_id, patch_id, round({_interval('l', 0, 0.3)}, 6) as s0, round({_interval('l', 0.02, 0.3)}, 6) as s1, round({_interval('l', 2, 5)}, 6) as s2, round({_interval('l', 0.5, 0.1)}, 6) as s3 from (select image_id, patch_id, list(d) as l from pim where layer = 0 group by all)",
        "mutual_score": "select category, subset, layer, image_id, patch_id, round(score, 6) as score from ms",
        "fused_reference_score": "select category, m.subset, m.layer, image_id, patch_id, round((w1 * x1 + w2 * x2) * m2 * m1, 6) as score from means m join wts using (category)",
        "mean_over_layers": "select category, image_id, patch_id, round(avg(score), 6) as score from ms group by all",
        "image_score": "select category, image_id, round(max(score), 6) as score from up group by all",
        "minmax_scores": "select category, image_id, round(score, 6) as score from mm",
        "graph_smooth": "select t.category, t.src as image_id, round(sum(w * score) / sum(w), 6) as score from top t join isc on isc.category = t.category and isc.image_id = t.dst where rk <= 2 group by all",
        "rescore_graph": _smooth([1, 2, 3]),
        "top_k_neighbors": "select category, src, dst, round(w, 6) + 0.0 as w, rk from top",
        "confusion_curve": "select grp, score, tp::bigint as tp, fp::bigint as fp, round(tp::double / (tp + fp), 6) as precision, round(tp::double / nullif(n1, 0), 6) as recall, round(fp::double / nullif(n0, 0), 6) as fpr from cv_ev",
        "cumulative_counts": "select grp, score, p::bigint as p, n::bigint as n, tp::bigint as tp, fp::bigint as fp from cv_li",
        **{k: f"select grp, round({v}, 6) as {v} from met_ev union all select grp, round({v}, 6) as {v} from met_li" for k, v in {"auroc": "auroc", "average_precision": "ap", "f1_max": "f1"}.items()},
        "image_metrics": "select grp as category, " + ", ".join(f"round(case when n1 > 0 and n0 > 0 then {a} else 0 end, 6) as {b}" for a, b in (("auroc", "auroc_sp"), ("f1", "f1_sp"), ("ap", "ap_sp"))) + " from met_spm",
        "label_regions": "select category, image_id, y, x, region from reg",
        "region_overlap_curve": f"select {curve} from roc",
        "aupro": "select category, round(aupro, 6) as aupro from pro",
        "pixel_metrics": "select grp as category, " + ", ".join(f"round(case when n1 > 0 then {a} else 0 end, 6) as {b}" for a, b in (("auroc", "auroc_px"), ("f1", "f1_px"), ("ap", "ap_px"), ("aupro", "aupro"))) + " from met_pxm left join pro on pro.category = grp",
        "evaluate": _report(),
        "category_report": _event_report(),
        "select_pseudo_normal": "select category, image_id, round(score, 6) as score from refs",
        "union_subsets": "select category, subset, count(*) as images, sum(is_anomaly)::bigint as anomalous from (select category, is_anomaly, (ntile(2) over (partition by category order by md5(image_id || ':0'), image_id) - 1)::int as subset from img) group by all",
        "fit_one_class": "select category, subset, layer, round(w1, 6) as w1, round(w2, 6) as w2, round(\"offset\", 6) as \"offset\" from wts",
        "apply_one_class": "select category, m.subset, m.layer, image_id, patch_id, round(w1 * x1 + w2 * x2, 6) as svm from means m join wts using (category)",
    }
    out = {k: _with(v) for k, v in plain.items()}
    degrees = ", ".join(str(r) for r in R_LIST)
    base = _with("select 1 from agg")
    head = base[: base.rindex("select 1 from agg")].rstrip()
    out["mean_over_degrees"] = f"{head}, dd as materialized (select a.category, a.degree, a.image_id, a.patch_id, b.image_id as ref, min(list_distance(a.feat, b.feat)) as d from agg a join agg b on a.category = b.category and a.degree = b.degree and a.image_id <> b.image_id and a.layer = b.layer and a.backbone = b.backbone where a.backbone = 1 and a.layer = 0 and a.degree in ({degrees}) group by all) select category, image_id, patch_id, round(avg(s), 6) as score from (select category, degree, image_id, patch_id, {_interval('list(d)', 0, 0.3)} as s from dd group by all) group by all"
    resampled = _with("select 1 from pat")
    head = resampled[: resampled.rindex("select 1 from pat")].rstrip()
    out["resample_grid"] = f"{head}, hs as (select i, greatest(0, (i + 0.5::double) * 4 / 6 - 0.5::double) as s from (select unnest(range(0, 6))::int as i)), tp as ({half}), rs as (select image_id, ty.i as y, tx.i as x, c, sum(v * ty.w * tx.w) as v from (select image_id, gy, gx, unnest(feat) as v, generate_subscripts(feat, 1) as c from pat where backbone = 1 and layer = 0) p join tp ty on p.gy = ty.g join tp tx on p.gx = tx.g group by all) select image_id, y, x, {_f6('list(v order by c)')} as feat from rs group by image_id, y, x"
    return out | _pipelines()
