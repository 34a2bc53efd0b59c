"""Named queries that write files from the synthetic tables, read them back and agree with SQL over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import hdf5, ranges
from .catalog import query


@query(
    "select cast(movie_id as bigint) movie, cast(row_number() over (partition by movie_id order by image_id)-1 as bigint) frame, cast(image_id as double) \"time\", 8 width, [cast(pix[[1]] as double)] first, [cast(pix[[11]] as double)] tenth, [list_sum(list_transform(pix, lambda x: cast(x as double)))] flux from img",
    "images",
)
def movie_files(img):
    """Images as frames of HDF5 movies, a file each, read back by ranges of frames."""
    folder = ranges.shared_folder(img.sparkSession)
    movies = img.select(F.col("movie_id").cast("long").alias("movie_id"), F.col("image_id").cast("double").alias("time"), F.lit(8).alias("width"), "pix")
    # Writing must be over before the folder is listed.
    hdf5.write_movies(movies, folder).write.format("noop").mode("overwrite").save()
    back = hdf5.read_movie(img.sparkSession, folder, "I")
    flux = F.aggregate("pix", F.lit(0.0), lambda s, x: s + x)
    return back.select(F.regexp_extract("file", r"(\d+)\.h5$", 1).cast("long").alias("movie"), "frame", "time", "width", F.get("pix", F.lit(0)).alias("first"), F.get("pix", F.lit(10)).alias("tenth"), flux.alias("flux"))
