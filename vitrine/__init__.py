"""Shop analytics as Spark jobs: catalogue, ratings, orders, vouchers, banners and their changes."""
