"""Planning of Sun, Moon, Milky Way and pole-star compositions as Spark DataFrames."""
