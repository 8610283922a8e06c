"""Fixed values of the Sentinel-1 and Sentinel-2 products and of the output store."""

# Band names in canonical order, with native resolution in metres.
S2_BANDS = {
    "B01": 60, "B02": 10, "B03": 10, "B04": 10, "B05": 20, "B06": 20,
    "B07": 20, "B08": 10, "B8A": 20, "B09": 60, "B11": 20, "B12": 20,
}
NBAR_BANDS = ("B02", "B03", "B04", "B05", "B06", "B07", "B08", "B11", "B12")
S1_BANDS = ("vh_asc", "vh_desc", "vv_asc", "vv_desc")
ORBITS = {"ascending": "asc", "descending": "desc"}
SNOW_BAND = "S2_snow_mask"
CLOUD_BAND = "S2_cloud_classification"
CLOUD_PROBABILITIES = ("S2_clear_sky_probability", "S2_thick_cloud_probability", "S2_thin_cloud_probability", "S2_shadow_probability")
SUBTILE = 732
TILE_PIXELS = 10980
# Harmonisation of processing baselines from 4.0 on, and the snow test.
BASELINE_OFFSET_FROM = 4.0
BASELINE_OFFSET = 1000
REFLECTANCE = 10000
SNOW_NDSI, SNOW_NIR, SNOW_GREEN = 0.15, 0.11, 0.1
# CF time attributes.
TIME_ATTRIBUTES = {"units": "seconds since 1970-01-01 00:00:00", "calendar": "proleptic_gregorian"}
METHODS = ("mean", "median", "min", "max")
#: Pixels of 10 m between two angles of a granule's metadata.
ANGLE_STEP = 500
RESAMPLING = ("nearest", "bilinear", "cubic", "cubic_spline", "lanczos", "average", "mode", "max", "min", "med", "q1", "q3", "sum", "rms")
