"""The bar builders over streams."""
