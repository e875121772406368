"""Columns of the landed tables: internal names, and the headers under which files have them. All cells are strings."""

from __future__ import annotations

# The headers of the files, in the order of their columns.
SEARCH = {
    "主商品ID(wareId)": "item_id",
    "SKU(skuId)": "sku_id",
    "标题(wareName)": "title",
    "标价(jdPrice,jdPriceText,realPrice)": "price",
    "券后到手价(couponPrice,subsidyPrice,finalPrice.estimatedPrice,priceShow)": "coupon_price",
    "原价(oriPrice,originalPrice,marketPrice)": "original_price",
    "卖点(sellingPoint)": "selling_point",
    "销量楼层(commentSalesFloor)": "comment_sales_floor",
    "榜单类文案(标签/腰带/标题数组中的榜、TOP 等)": "hot_list_rank",
    "评价量(commentFuzzy)": "comment_count",
    "店铺名(shopName)": "shop_name",
    "店铺链接(shopUrl,shopId)": "shop_url",
    "店铺信息链接(shopInfoUrl,brandUrl)": "shop_info_url",
    "地域(deliveryAddress,area,procity)": "location",
    "商品链接(toUrl,clickUrl,item.m.jd.com)": "detail_url",
    "主图(imageurl,imageUrl)": "image",
    "秒杀(seckillInfo,secKill)": "seckill_info",
    "规格属性(propertyList,color,catid,shortName)": "attributes",
    "类目(leafCategory,cid3Name,catid)": "leaf_category",
    "平台(platform)": "platform",
    "搜索词(keyword)": "keyword",
    "页码(page)": "page",
}
DETAIL_FIELDS = ("detail_brand", "detail_price_final", "detail_shop_name", "detail_category_path", "detail_product_attributes", "detail_body_ingredients")
DETAIL = {"skuId": "sku_id"} | {c: c for c in DETAIL_FIELDS}
COMMENTS = {
    "sku": "sku_id",
    "commentId": "comment_id",
    "userNickName": "user_nick_name",
    "tagCommentContent": "tag_comment_content",
    "commentDate": "comment_date",
    "buyCountText": "buy_count_text",
    "largePicURLs": "large_pic_urls",
    "commentScore": "comment_score",
}
_OF_SEARCH = {internal: header for header, internal in SEARCH.items()}
#: The merged table renames two columns of the listing and brings its own count of comments.
MERGED = (
    {"pipeline_keyword": "pipeline_keyword", _OF_SEARCH["sku_id"]: "sku_id", _OF_SEARCH["item_id"]: "ware_id"}
    | {_OF_SEARCH[c]: c for c in ("title", "price", "coupon_price", "original_price", "selling_point", "hot_list_rank")}
    | {_OF_SEARCH["comment_count"]: "comment_fuzzy"}
    | {_OF_SEARCH[c]: c for c in ("comment_sales_floor", "shop_name", "detail_url", "image", "attributes", "leaf_category", "keyword", "page")}
    | {c: c for c in DETAIL_FIELDS}
    | {"comment_count": "pipeline_comment_count", "comment_preview": "comment_preview"}
)
RELATIONS = {"search": SEARCH, "detail": DETAIL, "comments": COMMENTS, "merged": MERGED}
