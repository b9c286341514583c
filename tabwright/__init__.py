"""tabwright: a data-frame engine that plans everything through Spark SQL."""
