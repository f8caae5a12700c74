"""The driver's tables read as earth-data inputs, and the queries registered on them."""
