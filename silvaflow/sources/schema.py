"""Column types of the tables (as DDL, which readers take), and the one place where sentinels become null."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEGMENT = (
    "fid long, lon double, lat double, dt string, orb_orient int, orb_num int, rgt int, gt string, segid_beg long, segid_end long,"
    "h_can double, h_max_can double, h_can_quad double, h_can_unc double, rh25 double, rh50 double, rh60 double, rh70 double, rh75 double, rh80 double, rh85 double, rh90 double, rh95 double,"
    "n_ca_ph int, n_toc_ph int, n_te_ph int, n_seg_ph int, msw_flg int, cloud_flg int, night_flg int, seg_snow int, seg_water int, seg_landcov int,"
    "sig_topo double, sig_vert double, sig_acr double, sig_along double, sig_h double, h_te_best double, h_te_unc double, ter_slp double, snr double, sol_az double, sol_el double, asr double, h_dif_ref double,"
    "seg_cover double, tcc_flg int, tcc_prc double, granule_name string, rh_type string"
)
SERVICE = (
    "spot int, msw_flag int, snowcover int, segment_landcover int, h_canopy double, h_max_canopy double, h_mean_canopy double, canopy_h_metrics array<double>, solar_elevation double, sigma_topo double, h_dif_ref double, time timestamp"
)
FILE_INDEX = ("s3_path string, local_path string, file string, tile_num int, subtile_num int, n_obs int, created timestamp")
PIXEL = ("tile_num int, row int, col int, scene_id string, doy int, year int, blue double, green double, red double, nir double, swir double, swir2 double, qa int")
#: Names that models use for segment columns.
MODEL_NAMES = {"rh25": "RH_25", "rh50": "RH_50", "rh60": "RH_60", "rh70": "RH_70", "rh75": "RH_75", "rh80": "RH_80", "rh90": "RH_90", "rh95": "RH_95", "h_canopy": "RH_98", "h_can": "RH_98"}


def nulls(df: DataFrame, sentinels: Mapping[str, Sequence[float]] | None = None) -> DataFrame:
    """NaN becomes null in all floating columns, and listed values in theirs."""
    out = {}
    for f in df.schema:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out[f.name] = F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType))
    for name, values in (sentinels or {}).items():
        out[name] = F.when(~F.col(name).isin(*values), out.get(name, F.col(name)))
    return df.withColumns(out)


def model_named(df: DataFrame) -> DataFrame:
    """Segment columns under the names that models use."""
    return df.withColumnsRenamed({k: v for k, v in MODEL_NAMES.items() if k in df.columns})


def merged(df: DataFrame, *columns: Mapping[str, Column]) -> DataFrame:
    """Columns of several mappings; of equal names the later one counts."""
    out: dict[str, Column] = {}
    for more in columns:
        out |= more
    return df.withColumns(out)
