"""A cube request and its checks."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

from terrasieve import constants as C
from terrasieve.functions.crs import epsg
from terrasieve.plans.timeaxis import requested, seconds_of
from terrasieve.sources.catalog import provider

_FLAGS = ("reuse_open_datasets", "S2_mask_snow", "S2_cloud_classification", "S2_return_cloud_probabilities", "S2_apply_snow_mask", "S2_apply_cloud_mask", "S2_nbar", "overwrite", "consolidate_metadata", "save_as_uint16")


@dataclass(frozen=True)
class CubeSpec:
    """What to compute. validate() raises ValueError with the first rule that is broken."""

    target_crs: int | str
    target_resolution: float
    bound_left: float
    bound_bottom: float
    bound_right: float
    bound_top: float
    datetime: str
    zarr_store: str | None = None
    provider: str = "planetary_computer"
    reuse_open_datasets: bool = True
    processing_spatial_chunk_size: int = 4000
    S1_assets: tuple[str, ...] | None = C.S1_BANDS
    S2_bands: tuple[str, ...] | None = tuple(C.S2_BANDS)
    S2_mask_snow: bool = False
    S2_cloud_classification: bool = False
    S2_cloud_classification_device: str = "cpu"
    S2_return_cloud_probabilities: bool = False
    num_workers: int = 1
    time_composite_freq: str | None = None
    time_composite_method: str = "mean"
    S2_apply_snow_mask: bool = False
    S2_apply_cloud_mask: bool = False
    S2_nbar: bool = False
    overwrite: bool = False
    zarr_store_chunk_size: dict = field(default_factory=lambda: {"time": 10, "x": 250, "y": 250})
    coord_save_mode: str = "top-left"
    resampling_method: str = "nearest"
    consolidate_metadata: bool = True
    save_as_uint16: bool = False

    def validate(self) -> CubeSpec:
        def need(good: bool, message: str) -> None:
            if not good:
                raise ValueError(message)

        number = lambda v: isinstance(v, int | float) and not isinstance(v, bool)
        p = provider(self.provider)
        s1, s2 = tuple(self.S1_assets or ()), tuple(self.S2_bands or ())
        need(not s1 or "sentinel-1-rtc" in p.collections, f"{p.name} has no Sentinel-1 scenes")
        need(not self.S2_nbar or p.name == "planetary_computer", f"{p.name} has no granule metadata for S2_nbar")
        need(self.zarr_store is None or isinstance(self.zarr_store, str), "zarr_store must be a path")
        epsg(self.target_crs)
        need(number(self.target_resolution) and self.target_resolution > 0, "target_resolution must be a number above 0")
        for name in ("bound_left", "bound_bottom", "bound_right", "bound_top"):
            need(number(getattr(self, name)), f"{name} must be a number")
        need(self.bound_left < self.bound_right and self.bound_bottom < self.bound_top, "the bounds must span an area")
        size = self.processing_spatial_chunk_size
        need(isinstance(size, int) and not isinstance(size, bool) and size >= 1000, "processing_spatial_chunk_size must be an integer of 1000 or more")
        for name in _FLAGS:
            need(isinstance(getattr(self, name), bool), f"{name} must be true or false")
        need(isinstance(self.S1_assets, tuple | list | None) and set(s1) <= set(C.S1_BANDS), f"S1_assets must be a list of {C.S1_BANDS}")
        need(isinstance(self.S2_bands, tuple | list | None) and set(s2) <= set(C.S2_BANDS), f"S2_bands must be a list of {tuple(C.S2_BANDS)}")
        need(self.S2_cloud_classification_device in ("cpu", "cuda"), "the device must be cpu or cuda")
        need(isinstance(self.num_workers, int) and not isinstance(self.num_workers, bool) and self.num_workers > 0, "num_workers must be an integer above 0")
        if self.time_composite_freq is not None:
            need(isinstance(self.time_composite_freq, str), "time_composite_freq must be text")
            seconds_of(self.time_composite_freq)
            if s2 and not (self.S2_apply_snow_mask or self.S2_apply_cloud_mask):
                warnings.warn("compositing without a cloud or snow mask", stacklevel=2)
        need(self.time_composite_method in C.METHODS, f"time_composite_method must be one of {C.METHODS}")
        need(not self.S2_apply_snow_mask or self.S2_mask_snow, "S2_apply_snow_mask needs S2_mask_snow")
        need(not self.S2_apply_cloud_mask or self.S2_cloud_classification, "S2_apply_cloud_mask needs S2_cloud_classification")
        need(not self.S2_return_cloud_probabilities or self.S2_cloud_classification, "S2_return_cloud_probabilities needs S2_cloud_classification")
        chunk = self.zarr_store_chunk_size
        need(isinstance(chunk, dict) and {"time", "x", "y"} <= set(chunk) and all(isinstance(v, int) and v > 0 for v in chunk.values()), "zarr_store_chunk_size needs time, x and y")
        need(self.coord_save_mode in ("top-left", "center"), "coord_save_mode must be top-left or center")
        need(self.resampling_method in C.RESAMPLING, f"resampling_method must be one of {C.RESAMPLING}")
        need(not (self.save_as_uint16 and s1), "save_as_uint16 is for Sentinel-2 alone")
        options = self.S2_mask_snow or self.S2_cloud_classification or self.S2_return_cloud_probabilities or self.S2_nbar
        need(bool(s2) or (bool(s1) and not options), "without S2_bands there must be S1_assets and no Sentinel-2 option")
        need(not self.S2_cloud_classification or set(s2) == set(C.S2_BANDS), "S2_cloud_classification needs all bands")
        need(not self.S2_mask_snow or {"B03", "B08", "B11"} <= set(s2), "S2_mask_snow needs B03, B08 and B11")
        need(not self.S2_nbar or set(C.NBAR_BANDS) <= set(s2), f"S2_nbar needs {C.NBAR_BANDS}")
        requested(self.datetime)
        return self

    @property
    def raw_bands(self) -> list[str]:
        """Sentinel-2 bands in canonical order, whatever order was asked for."""
        return [b for b in C.S2_BANDS if b in (self.S2_bands or ())]

    @property
    def bands(self) -> list[str]:
        """All bands of the cube; masks are saved only without compositing."""
        extra = []
        if self.time_composite_freq is None:
            extra += [C.SNOW_BAND] * self.S2_mask_snow + [C.CLOUD_BAND] * self.S2_cloud_classification
        extra += list(C.CLOUD_PROBABILITIES) * self.S2_return_cloud_probabilities
        return self.raw_bands + extra + list(self.S1_assets or ())
