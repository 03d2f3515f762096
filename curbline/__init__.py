"""Last-mile transit analytics as Spark jobs.

``functions`` holds column expressions, ``operators`` DataFrame -> DataFrame
steps, ``sources`` readers and writers of landed files, ``streaming`` the
incremental forms, and ``plans`` the complete jobs plus the query registry.
"""

from curbline.session import configure, scratch_dir

__all__ = ["configure", "scratch_dir"]
