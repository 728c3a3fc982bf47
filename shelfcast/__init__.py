"""shelfcast — retail demand and stock analytics on Spark.

Every public operator takes DataFrames and returns a DataFrame that covers
all products at once. Nothing is collected to the driver.
"""

__version__ = "0.1.0"
